"""Evaluation of detected against labelled spans. Input rows have ``gold`` and ``pred`` span arrays; nothing is collected.

Arrays are exploded by explode_outer: for explode, Catalyst infers a filter on the array and pushes it down, which would
compute a detector's large expression once more (and, nested, many times).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.spans import dedup_by_emission, find_all, let, match, overlaps, span, text_of
from veilspan.operators.detect import could_hold_entity, scan_entropy, shannon_entropy


def confusion(rows: DataFrame, gold: str = "gold", pred: str = "pred", outer: str = "gold") -> DataFrame:
    """type, tp, fp, fn summed over all rows; greedy matching within equal types, with gold or predicted spans leading."""

    lead, follow = ("gold", "pred") if outer == "gold" else ("pred", "gold")
    side = {lead: "outer", follow: "inner"}

    def marked(both: Column, which: str, hit: str, miss: str) -> Column:
        def one(s: Column, i: Column) -> Column:
            return F.struct(s["type"].alias("type"), F.when(F.exists(both["pairs"], lambda q: q[side[which]] == i), F.lit(hit)).otherwise(F.lit(miss)).alias("kind"))

        return F.transform(both[which], one)

    def counts(both: Column) -> Column:
        return F.concat(marked(both, "gold", "tp", "fn"), F.filter(marked(both, "pred", "", "fp"), lambda m: m["kind"] == "fp"))

    def with_pairs(both: Column) -> Column:
        return let(F.struct(both["gold"].alias("gold"), both["pred"].alias("pred"), match(both[lead], both[follow]).alias("pairs")), counts)

    spans = F.struct(F.col(gold).alias("gold"), dedup_by_emission(F.col(pred)).alias("pred"))
    marks = rows.select(F.inline(let(spans, with_pairs)))
    return marks.groupBy("type").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")])


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def metrics(counts: DataFrame) -> DataFrame:
    """type, tp, fp, fn, precision, recall, f1 of each type, and of all together as MICRO-AVG; 0 where nothing divides."""
    sums = counts.rollup("type").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")], F.grouping_id().alias("level"))
    sums = sums.select(F.when(F.col("level") == 1, "MICRO-AVG").otherwise(F.col("type")).alias("type"), *[F.coalesce(k, F.lit(0)).alias(k) for k in ("tp", "fp", "fn")])
    rates = sums.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return rates.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


ENTROPY_LENGTHS, ENTROPY_THRESHOLDS = (12, 16, 20), (3.3, 3.6, 3.9, 4.2)


def entropy_sweep(rows: DataFrame, gold: str = "gold", text: str = "log", lengths=ENTROPY_LENGTHS, thresholds=ENTROPY_THRESHOLDS) -> DataFrame:
    """min_len, threshold, tp, fp, fn, precision, recall, f1, false_alarm_rate (flagged clean lines of all clean ones) for
    every combination; hits lead the matching, whatever the type. Tokens and entropies are found once for all settings."""
    token = lambda m, s, e: F.when(~m.rlike(P.UUID), let(shannon_entropy(m), lambda h: span(P.HIGH_ENTROPY, s, e, "entropy", entropy=h)))
    found = rows.select(F.col(gold).alias("gold"), find_all(F.col(text), P.ENTROPY_TOKEN, token).alias("tokens"))
    settings = F.array(*[F.struct(F.lit(n).alias("min_len"), F.lit(t).alias("threshold")) for n in lengths for t in thresholds])
    each = found.select("gold", "tokens", F.inline(settings))
    hits = F.filter("tokens", lambda s: (s["end"] - s["start"] >= F.col("min_len")) & (s["entropy"] >= F.col("threshold")))
    each = each.withColumn("hits", hits)
    each = each.select("min_len", "threshold", F.size("gold").alias("golds"), F.size("hits").alias("flags"), F.size(match(F.col("hits"), F.col("gold"), same_type=False)).alias("tp"))
    sums = each.groupBy("min_len", "threshold").agg(
        F.sum("tp").alias("tp"), F.sum(F.col("flags") - F.col("tp")).alias("fp"), F.sum(F.col("golds") - F.col("tp")).alias("fn"),
        F.count_if(F.col("golds") == 0).alias("clean"), F.count_if((F.col("golds") == 0) & (F.col("flags") > 0)).alias("flagged"),
    )
    rates = sums.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn")), "false_alarm_rate": _ratio(F.col("flagged"), F.col("clean"))})
    return rates.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("clean", "flagged")


def best_setting(sweep: DataFrame) -> DataFrame:
    """The setting of the highest F1; of equal ones the first in order of length and threshold."""
    best = F.max_by(F.struct("min_len", "threshold", "f1"), F.struct("f1", -F.col("min_len"), -F.col("threshold")))
    return sweep.agg(best.alias("best")).select("best.*")


def entropy_false_alarms(rows: DataFrame, gold: str = "gold", text: str = "log", examples: int = 8) -> DataFrame:
    """One row: flags, those that overlap a labelled span, those on clean lines, clean lines flagged, and up to ``examples``
    flagged tokens of clean lines (none for 0)."""

    def line(both: Column) -> Column:
        hit = F.filter(both["hits"], lambda h: F.exists(both["gold"], lambda g: overlaps(h, g)))
        tokens = F.transform(both["hits"], lambda h: text_of(both["text"], h))
        return F.struct(F.size(both["hits"]).alias("flags"), F.size(hit).alias("hit"), (F.size(both["gold"]) == 0).alias("clean"), tokens.alias("tokens"))

    lines = rows.select(let(F.struct(F.col(gold).alias("gold"), F.col(text).alias("text"), scan_entropy(F.col(text)).alias("hits")), line).alias("line")).select("line.*")
    counts = lines.agg(
        F.sum("flags").alias("flags"), F.sum("hit").alias("overlapping_gold"), F.sum(F.when(F.col("clean"), F.col("flags")).otherwise(0)).alias("on_clean_lines"),
        F.count_if(F.col("clean") & (F.col("flags") > 0)).alias("clean_lines_flagged"), F.count_if("clean").alias("clean_lines"),
    )
    if not examples:
        return counts
    shown = lines.where("clean").select(F.explode("tokens").alias("token")).distinct().orderBy("token").limit(examples)
    return counts.withColumn("k", F.lit(1)).join(shown.agg(F.sort_array(F.collect_list("token")).alias("examples")).withColumn("k", F.lit(1)), "k").drop("k")  # a row each


def person_formats(rows: DataFrame, gold: str = "gold", pred: str = "pred", text: str = "log") -> DataFrame:
    """format (flat or spaced), gold spans and those that any predicted PERSON overlaps (not one-to-one)."""
    people = rows.select(F.col(text).alias("text"), F.col(pred).alias("pred"), F.explode_outer(gold).alias("g")).where("g.type = 'PERSON'")
    found = F.exists("pred", lambda p: (p["type"] == "PERSON") & overlaps(p, F.col("g")))
    spaced = F.contains(text_of(F.col("text"), F.col("g")), F.lit(" "))
    return people.select(F.when(spaced, "spaced").otherwise("flat").alias("format"), found.alias("found")).groupBy("format").agg(F.count("*").alias("gold"), F.count_if("found").alias("matched"))


def type_tally(rows: DataFrame, strategies: dict[str, Column]) -> DataFrame:
    """type and a count column for each strategy's span array."""
    parts = F.array(*[F.struct(F.lit(name).alias("strategy"), spans.alias("spans")) for name, spans in strategies.items()])
    each = rows.select(F.inline(parts)).select("strategy", F.explode_outer("spans").alias("s")).where("s is not null").select("strategy", "s.type")
    return each.groupBy("type").pivot("strategy", list(strategies)).count().na.fill(0)


def early_exit_safety(rows: DataFrame, gold: str = "gold", text: str = "log", by: str = "log_type") -> DataFrame:
    """For each value of ``by``: lines, lines that the early exit skips, skipped lines with labelled spans (which must be none),
    and lines with labelled spans."""
    skipped, some = ~could_hold_entity(F.col(text)), F.size(gold) > 0
    return rows.groupBy(by).agg(F.count("*").alias("lines"), F.count_if(skipped).alias("skipped"), F.count_if(skipped & some).alias("skipped_with_gold"), F.count_if(some).alias("with_gold"))


def unmatched(rows: DataFrame, gold: str = "gold", pred: str = "pred", id_: str = "line_id") -> DataFrame:
    """The false positives: predicted spans that no labelled span of their type overlaps."""
    each = rows.select(id_, F.col(gold).alias("gold"), F.explode_outer(pred).alias("p")).where("p is not null")
    return each.where(~F.exists("gold", lambda g: (g["type"] == F.col("p.type")) & overlaps(g, F.col("p")))).select(id_, "p.*")


def account_id_share(rows: DataFrame, gold: str = "gold", pred: str = "pred", text: str = "log") -> DataFrame:
    """One row: CREDIT_CARD false positives, and those whose text is an accountId of the same line."""
    each = rows.select(F.col(text).alias("text"), F.col(gold).alias("gold"), F.explode_outer(pred).alias("p")).where("p.type = 'CREDIT_CARD'")
    false = each.where(~F.exists("gold", lambda g: (g["type"] == "CREDIT_CARD") & overlaps(g, F.col("p"))))
    ids = F.regexp_extract_all("text", F.lit(r'[aA]ccountId"\s*:\s*"(\d+)"'), F.lit(1))
    return false.agg(F.count("*").alias("false_positives"), F.count_if(F.array_contains(ids, text_of(F.col("text"), F.col("p")))).alias("account_ids"))


def span_difference(a: DataFrame, b: DataFrame, columns: tuple[str, ...] = ("line_id", "type", "start", "end")) -> DataFrame:
    """Spans of ``a`` that ``b`` lacks."""
    return a.select(*columns).exceptAll(b.select(*columns))


def dictionary_coverage(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row: distinct names (name, count), those in the dictionary (name), and both shares, plain and by frequency."""
    known = dictionary.select(F.lower("name").alias("name")).distinct().withColumn("known", F.lit(True))
    sums = names.groupBy(F.lower("name").alias("name")).agg(F.sum("count").alias("count")).join(known, "name", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    found = sums.agg(F.count("*").alias("names"), F.count_if("known").alias("covered"), F.sum("count").alias("total"), F.sum(F.when(F.col("known"), F.col("count")).otherwise(0)).alias("covered_total"))
    return found.select("names", "covered", _ratio(F.col("covered"), F.col("names")).alias("distinct_coverage"), _ratio(F.col("covered_total"), F.col("total")).alias("weighted_coverage"))


NAME_BUCKETS = 256


def weighted_sample(names: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """``draws`` names with replacement, by count: draw, name. Each draw's hashed place in the cumulative counts is joined by
    range within blocks of the number line, so that no draw meets every name."""
    from pyspark.sql import Window as W

    totals = names.groupBy(F.lower("name").alias("name")).agg(F.sum("count").alias("count")).where("count > 0")
    grand = totals.agg(F.sum("count")).first()[0] or 0
    if not grand:
        return names.sparkSession.createDataFrame([], "draw long, name string")
    # cumulative counts in two steps: over hashed buckets of names, and within each bucket
    totals = totals.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(NAME_BUCKETS)))
    sums = totals.groupBy("bucket").agg(F.sum("count").alias("in_bucket"))
    before = sums.select("bucket", (F.sum("in_bucket").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("in_bucket")).alias("before"))
    upto = F.sum("count").over(W.partitionBy("bucket").orderBy("name").rowsBetween(W.unboundedPreceding, 0))
    placed = totals.withColumn("upto", upto).join(F.broadcast(before), "bucket")  # a row per bucket
    placed = placed.select("name", (F.col("before") + F.col("upto") - F.col("count")).alias("low"), (F.col("before") + F.col("upto")).alias("high"))
    step = max(1, grand // 1000)
    placed = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / step), F.floor((F.col("high") - 1) / step))))
    drawn = names.sparkSession.range(draws).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(grand)).alias("at")).withColumn("block", F.floor(F.col("at") / step))
    return drawn.join(placed, "block").where("at >= low and at < high").select("draw", "name")


def recall_by_locale(rows: DataFrame, detected: Column, locale: str = "locale", name: str = "name") -> DataFrame:
    """locale, is_ascii, names, found, recall of user names made from labelled names."""
    ascii_ = ~F.col(name).rlike(r"[^\x00-\x7F]")
    sums = rows.select(F.col(locale).alias("locale"), ascii_.alias("is_ascii"), (F.size(detected) > 0).alias("found")).groupBy("locale", "is_ascii").agg(F.count("*").alias("names"), F.count_if("found").alias("found"))
    return sums.withColumn("recall", _ratio(F.col("found"), F.col("names")))


def reconcile(expected: DataFrame, routed: DataFrame) -> DataFrame:
    """One row: exact counts, whether every expected line came out on one side (false for none expected), and the characters
    that came out, which none but the finished texts can give. ``routed``: rows of the sinks (sink, message)."""
    parts = [expected.select(F.lit("expected").alias("sink"), F.lit(0).alias("chars")), routed.select("sink", F.length("message").alias("chars"))]
    sides = ("expected", "anonymized", "quarantine")
    counts = parts[0].unionAll(parts[1]).agg(
        *[F.count_if(F.col("sink") == n).alias(n) for n in sides], *[F.coalesce(F.sum(F.when(F.col("sink") == n, F.col("chars"))), F.lit(0)).alias(f"{n}_chars") for n in sides[1:]]
    )
    return counts.withColumn("reconciled", (F.col("anonymized") + F.col("quarantine") == F.col("expected")) & (F.col("expected") > 0))


def corpus_integrity(rows: DataFrame, gold: str = "gold", text: str = "log", low: float = 0.25, high: float = 0.35) -> DataFrame:
    """One row: lines, labelled spans out of range or empty, share of lines with spans, and whether all of it is as it must be."""
    bad = F.size(F.filter(gold, lambda g: (g["start"] < 0) | (g["end"] > F.length(text)) | (g["start"] >= g["end"])))
    sums = rows.agg(F.count("*").alias("lines"), F.sum(bad).alias("bad_spans"), F.avg((F.size(gold) > 0).cast("double")).alias("dirty_ratio"))
    return sums.withColumn("valid", (F.col("bad_spans") == 0) & F.col("dirty_ratio").between(low, high))


def strategy_profile(rows: DataFrame, regex_hits: Column, candidate: Column) -> DataFrame:
    """One row: entity calls of the field gate by bucket (on cut lines, skipped, and on lines without regex hits), and the
    characters that the calls on lines with hits still search."""
    hit, text = F.size(regex_hits) > 0, candidate["candidate"]
    return rows.agg(
        F.count_if(hit & text.isNotNull()).alias("ner_calls_made"), F.count_if(hit & text.isNull()).alias("ner_calls_skipped"), F.count_if(~hit).alias("no_regex_hit_ner_calls"),
        F.sum(F.when(hit, F.length(text))).alias("characters_searched"),
    )
