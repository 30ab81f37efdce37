"""Drift of the share of critical values in each field between two windows, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.fields import extract_fields
from veilspan.operators.detect import NerProvider, scan_flattened_names, scan_regex


def is_critical(value: Column, ner: NerProvider | None = None) -> Column:
    """Whether detectors find a critical type in the value alone (IP addresses are none, entropy takes no part). Cheap tests
    come first; spans are only built where a card number or a name could be."""
    certain = P.UNICODE + "|".join(P.REGEX_PATTERNS[k] for k in ("SSN", "EMAIL", "MRN"))
    card = value.rlike(P.UNICODE + P.REGEX_PATTERNS["CREDIT_CARD"]) & (F.size(scan_regex(value, ("CREDIT_CARD",))) > 0)
    found = F.when(value.rlike(certain), True).when(card, True).when(F.size(scan_flattened_names(value)) > 0, True)
    if ner:
        found = found.when(F.exists(ner(value), lambda s: s["type"].isin(*P.CRITICAL_TYPES)), True)
    return found.otherwise(False)


def field_values(entries: DataFrame, log_type: str = "log_type", text: str = "log") -> DataFrame:
    """log_type, field and value of every field of every line."""
    return entries.select(F.col(log_type).alias("log_type"), F.inline(extract_fields(F.col(log_type), F.col(text)))).select("log_type", "field", "value")


def field_stats(entries: DataFrame, ner: NerProvider | None = None, **columns: str) -> DataFrame:
    """log_type, field, total, critical_hits. Values are searched where they are; only counts are shuffled."""
    hit = F.when(is_critical(F.col("value"), ner), 1).otherwise(0)
    return field_values(entries, **columns).groupBy("log_type", "field").agg(F.count("*").alias("total"), F.sum(hit).alias("critical_hits"))


def _joined(baseline: DataFrame, current: DataFrame) -> DataFrame:
    b = baseline.select("log_type", "field", F.col("total").alias("baseline_n"), F.col("critical_hits").alias("baseline_hits"))
    c = current.select("log_type", "field", F.col("total").alias("current_n"), F.col("critical_hits").alias("current_hits"))
    return b.join(c, ["log_type", "field"], "full").na.fill(0, ["baseline_n", "baseline_hits", "current_n", "current_hits"])


def _enough() -> Column:
    return (F.col("baseline_n") >= P.DRIFT_MIN_SAMPLE) & (F.col("current_n") >= P.DRIFT_MIN_SAMPLE)


def compare_all(baseline: DataFrame, current: DataFrame | None = None, threshold: float = P.DRIFT_THRESHOLD) -> DataFrame:
    """Every field with enough values in both windows, flagged where the unrounded rates differ by the threshold or more. Takes
    the statistics of both windows, or those that ``halves`` gives alone."""
    rates = (baseline if current is None else _joined(baseline, current)).where(_enough())
    rates = rates.select("log_type", "field", (F.col("baseline_hits") / F.col("baseline_n")).alias("baseline_rate"), (F.col("current_hits") / F.col("current_n")).alias("current_rate"), "baseline_n", "current_n")
    delta = F.col("current_rate") - F.col("baseline_rate")
    return rates.select("log_type", "field", "baseline_rate", "current_rate", delta.alias("delta"), "baseline_n", "current_n", (F.abs(delta) >= threshold).alias("flagged"))


def compare(baseline: DataFrame, current: DataFrame | None = None, threshold: float = P.DRIFT_THRESHOLD) -> DataFrame:
    """The flagged fields, the largest change first."""
    return compare_all(baseline, current, threshold).where("flagged").drop("flagged").orderBy(F.desc(F.abs("delta")), "log_type", "field")


def insufficient(baseline: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Fields with too few values in a window."""
    return (baseline if current is None else _joined(baseline, current)).where(~_enough()).select("log_type", "field", "baseline_n", "current_n")


def rounded(compared: DataFrame, digits: int = 4) -> DataFrame:
    """For display: rates are compared unrounded."""
    return compared.withColumns({c: F.bround(c, digits) for c in ("baseline_rate", "current_rate", "delta")})


def summary(baseline_entries: DataFrame, current_entries: DataFrame, threshold: float = P.DRIFT_THRESHOLD, ner: NerProvider | None = None) -> DataFrame:
    """One row: entries of both windows, fields flagged and fields with too few values."""
    b, c = field_stats(baseline_entries, ner), field_stats(current_entries, ner)
    fields = _joined(b, c).withColumn("delta", F.col("current_hits") / F.nullif("current_n", F.lit(0)) - F.col("baseline_hits") / F.nullif("baseline_n", F.lit(0)))
    counts = fields.agg(F.count_if(_enough() & (F.abs("delta") >= threshold)).alias("fields_flagged"), F.count_if(~_enough()).alias("fields_insufficient_data"))
    windows = baseline_entries.select(F.lit("b").alias("w")).unionAll(current_entries.select(F.lit("c").alias("w")))
    sizes = windows.agg(F.count_if(F.col("w") == "b").alias("baseline_entries"), F.count_if(F.col("w") == "c").alias("current_entries"))
    return sizes.withColumn("k", F.lit(1)).join(counts.withColumn("k", F.lit(1)), "k").drop("k")  # a row each


def halves(entries: DataFrame, first: Column, log_type: str = "log_type", text: str = "log") -> DataFrame:
    """Statistics of two windows in one pass: log_type, field, baseline_n, baseline_hits, current_n, current_hits. ``first`` tells
    which lines are the baseline."""
    values = entries.select(first.alias("first"), F.col(log_type).alias("log_type"), F.inline(extract_fields(F.col(log_type), F.col(text))))
    values = values.select("first", "log_type", "field", is_critical(F.col("value")).alias("hit"))
    counts = {f"{w}_{k}": F.count_if(c) for w, of in (("baseline", F.col("first")), ("current", ~F.col("first"))) for k, c in (("n", of), ("hits", of & F.col("hit")))}
    return values.groupBy("log_type", "field").agg(*[c.alias(n) for n, c in counts.items()])


def metric_rows(compared: DataFrame) -> DataFrame:
    """metric, log_type, field, value: two gauges for each field."""
    return compared.select("log_type", "field", F.expr("stack(2, 'critical_hit_rate', current_rate, 'flagged', cast(flagged as double)) as (metric, value)"))


def firing(metrics: DataFrame) -> DataFrame:
    """The alert rule on gauges: fields whose flag is 1."""
    return metrics.where("metric = 'flagged' and value = 1")


def slow_windows(latencies: DataFrame, ts: str = "ts", seconds: str = "seconds", limit: float = 1.0, over: str = "5 minutes") -> DataFrame:
    """The alert rule on latency: windows whose 95th percentile is over the limit. The percentile is exact: the least value that
    95 % of the window's values, or more, do not exceed. What has no time is a window of its own, which is null.

    Equal values are counted first. Values are then counted by size, in steps of about 0.3 %, to find the step that holds the
    percentile; only the values of this step are ranked, so that no task gets all values of a window."""
    at = F.coalesce(F.col(ts), F.lit("1970-01-01").cast(latencies.select(ts).schema[0].dataType))  # windows leave null times out
    window, size = F.when(F.col(ts).isNotNull(), F.window(at, over)), F.col("p95").cast("double")
    step = F.struct(F.signum(size).alias("sign"), F.coalesce(F.signum(size) * F.rint(F.log2(F.abs(size)) * 256), F.lit(0.0)).alias("size"))
    rows = latencies.where(F.col(seconds).isNotNull()).select(window.alias("window"), F.col(seconds).alias("p95"))
    counts = rows.groupBy("window", "p95").agg(F.count("*").alias("n")).withColumn("step", step)
    whole = Window.partitionBy("window")
    so_far = lambda by: F.sum("n").over(whole.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    holds = (F.col("so_far") >= F.col("rank")) & (F.col("so_far") - F.col("n") < F.col("rank"))
    steps = counts.groupBy("window", "step").agg(F.sum("n").alias("n"))
    steps = steps.withColumns({"so_far": so_far("step"), "total": F.sum("n").over(whole)}).withColumn("rank", F.expr("(total * 95 + 99) div 100")).where(holds)
    steps = steps.select(F.col("window").alias("_window"), F.col("step").alias("_step"), (F.col("rank") - F.col("so_far") + F.col("n")).alias("rank"))
    values = counts.join(steps, F.equal_null("window", "_window") & F.equal_null("step", "_step"))
    return values.withColumn("so_far", so_far("p95")).where(holds & (F.col("p95") > limit)).select("window", "p95")


def review_sample(processed: DataFrame, rate: float = 0.05, seed: int = 0, line_id: str = "line_id") -> DataFrame:
    """An exact sample for review among lines with spans: max(1, floor(n * rate)) of them, in the order of a keyed hash, lines
    without an id last.

    Lines with spans are counted by the hash's first digits, so that it is known with which digits the sample ends. What lies
    beyond is put aside before anything is searched a second time, what lies before is taken whole, and only the lines of
    these last digits, about one in 4,096, are ranked."""
    order = F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col(line_id).cast("string"))), F.lit("~"))
    has_spans = F.col("detector_span_count") > 0
    counts = processed.groupBy(F.substring(order, 1, 3).alias("digits")).agg(F.count_if(has_spans).alias("n")).collect()
    n = sum(r["n"] for r in counts)
    if not n:
        return processed.limit(0)
    left = max(1, int(n * rate))
    for last, here in sorted((r["digits"], r["n"]) for r in counts):
        if left <= here:
            break
        left -= here

    def found(rows: DataFrame) -> DataFrame:
        # a filter on the count itself would go below what makes the text, and make it anew wherever detectors look at it
        return rows.select("*", F.explode_outer(F.when(has_spans, F.array(F.lit(True)))).alias("_veil_found")).where("_veil_found").drop("_veil_found")

    rows = processed.withColumn("_veil_order", order)
    ends = found(rows.where(F.startswith("_veil_order", F.lit(last)))).orderBy("_veil_order", line_id).limit(left)
    return found(rows.where(F.col("_veil_order") < last)).unionAll(ends).orderBy("_veil_order", line_id).drop("_veil_order")
