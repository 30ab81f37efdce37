"""The field gate: named entities are searched on what regular expressions have not covered yet.

Values of a line's fields that a regex hit overlaps are cut out (with the key before them) and the rest goes to the entity
provider; its hits are mapped back to the whole line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.fields import extract_fields, no_fields
from veilspan.functions.spans import let
from veilspan.operators.detect import NerProvider, scan_entropy, scan_flattened_names, scan_regex

RANGES = "array<struct<s:int,e:int>>"
SEGMENTS = "array<struct<candidate_start:int,original_start:int>>"


def _find(value: Column, text: Column, cursor: Column) -> Column:
    """Place of the value from the cursor on, else from the start, from 0; -1 where it isn't."""
    found = F.call_function("locate", value, text, cursor + 1)
    return F.when(found > 0, found).otherwise(F.call_function("locate", value, text, F.lit(1))) - 1


def _excised(text: Column, hits: Column, fields: Column) -> Column:
    """Ranges to cut out, and whether a value with a letter stays."""
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast(RANGES).alias("ranges"), F.lit(False).alias("letters"))

    def step(state: Column, field: Column) -> Column:
        value = field["value"]

        def at(i: Column) -> Column:
            end = i + F.length(value)
            hit = F.exists(hits, lambda h: (h["start"] < end) & (i < h["end"]))
            key = F.length(F.regexp_extract(F.substring(text, F.lit(1), i), P.UNICODE + P.EXCISED_KEY, 0))
            cut = F.concat(state["ranges"], F.array(F.struct((i - key).cast("int").alias("s"), end.cast("int").alias("e"))))
            moved = F.struct(
                end.cast("int").alias("cursor"), F.when(hit, cut).otherwise(state["ranges"]).alias("ranges"), (state["letters"] | (~hit & value.rlike(r"\p{L}"))).alias("letters")
            )
            return F.when(i < 0, state).otherwise(moved)

        return F.when(F.length(value) > 0, let(_find(value, text, state["cursor"]).cast("int"), at)).otherwise(state)

    return F.aggregate(fields, start, step)


def _merged(ranges: Column) -> Column:
    def step(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], r["e"]).alias("e"))))
        return F.when(F.size(done) == 0, F.array(r)).when(r["s"] <= F.get(done, F.size(done) - 1)["e"], joined).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.sort_array(ranges), F.array().cast(RANGES), step)


def _spliced(text: Column, ranges: Column) -> Column:
    start = F.struct(F.lit("").alias("candidate"), F.array().cast(SEGMENTS).alias("segments"), F.lit(0).alias("cursor"))

    def step(state: Column, r: Column) -> Column:
        kept = r["s"] > state["cursor"]
        segment = F.array(F.struct(F.length(state["candidate"]).alias("candidate_start"), state["cursor"].alias("original_start")))
        return F.struct(
            F.concat(state["candidate"], F.substring(text, state["cursor"] + 1, F.greatest(r["s"] - state["cursor"], F.lit(0)))).alias("candidate"),
            F.when(kept, F.concat(state["segments"], segment)).otherwise(state["segments"]).alias("segments"),
            r["e"].alias("cursor"),
        )

    end = F.array(F.struct(F.length(text).alias("s"), F.length(text).alias("e")))
    return F.aggregate(F.concat(ranges, end), start, step)


CANDIDATE = f"struct<candidate:string,segments:{SEGMENTS}>"


def ner_candidate(text: Column, hits: Column, fields: Column) -> Column:
    """struct<candidate, segments>: the text itself and no segments where nothing is cut out; a null candidate where what
    stays has no letter, so that nothing needs to be searched."""
    unchanged = F.struct(text.alias("candidate"), F.lit(None).cast(SEGMENTS).alias("segments"))
    nothing = F.struct(F.lit(None).cast("string").alias("candidate"), F.lit(None).cast(SEGMENTS).alias("segments"))

    def build(cut: Column) -> Column:
        spliced = let(_spliced(text, _merged(cut["ranges"])), lambda s: F.struct(s["candidate"].alias("candidate"), s["segments"].alias("segments")))
        return F.when(F.size(cut["ranges"]) == 0, unchanged).when(~cut["letters"], nothing).otherwise(spliced)

    return let(_excised(text, hits, fields), build)


def remap(hits: Column, segments: Column) -> Column:
    """Hits in a candidate at their places in the whole line; unchanged where there are no segments."""

    def move(h: Column) -> Column:
        segment = F.element_at(F.filter(segments, lambda s: s["candidate_start"] <= h["start"]), -1)
        by = segment["original_start"] - segment["candidate_start"]
        return h.withField("start", h["start"] + by).withField("end", h["end"] + by)

    return F.when(segments.isNull(), hits).otherwise(F.transform(hits, move))


STRATEGIES = ("regex_only", "tiered", "field_gated", "naive", "naive_flattened")
_HITS, _FIELDS, _GATED = "_veil_hits", "_veil_fields", "_veil_gated"


def with_candidate(df: DataFrame, text: str = "log", log_type: str = "log_type") -> DataFrame:
    """``df`` with _veil_hits (of the regular expressions) and _veil_gated (``ner_candidate``; the whole text of a line without
    hits). Each step is a column of its own: fields and entities may come from Python, which can't run within lambdas."""
    rows = df.withColumn(_HITS, scan_regex(F.col(text)))
    some = F.size(_HITS) > 0
    rows = rows.withColumn(_FIELDS, F.when(some, extract_fields(F.when(some, F.col(log_type)), F.col(text))).otherwise(no_fields()))
    whole = F.struct(F.col(text).alias("candidate"), F.lit(None).cast(SEGMENTS).alias("segments"))
    return rows.withColumn(_GATED, F.when(some, ner_candidate(F.col(text), F.col(_HITS), F.col(_FIELDS))).otherwise(whole).cast(CANDIDATE)).drop(_FIELDS)


def predicted(df: DataFrame, strategy: str, ner: NerProvider, text: str = "log", log_type: str = "log_type", out: str = "pred") -> DataFrame:
    """``df`` with the spans, in emission order, that one of the evaluated strategies gives; entropy takes no part. Lines that
    need no search for entities reach the provider as null."""
    regex = scan_regex(F.col(text))
    if strategy == "regex_only":
        return df.withColumn(out, regex)
    if strategy == "naive":
        return df.withColumn(out, F.concat(regex, ner(F.col(text))))
    if strategy == "naive_flattened":
        return df.withColumn(out, F.concat(regex, ner(F.col(text)), scan_flattened_names(F.col(text))))
    if strategy == "tiered":
        rows = df.withColumn(_HITS, regex)
        return rows.withColumn(out, F.concat(F.col(_HITS), ner(F.when(F.size(_HITS) == 0, F.col(text))))).drop(_HITS)
    if strategy == "field_gated":
        rows = with_candidate(df, text, log_type)
        found = remap(ner(F.col(f"{_GATED}.candidate")), F.col(f"{_GATED}.segments"))
        return rows.withColumn(out, F.concat(F.col(_HITS), found)).drop(_HITS, _GATED)
    raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")


def detect_field_gated(df: DataFrame, ner: NerProvider, flattened: bool = True, text: str = "log", log_type: str = "log_type", out: str = "spans") -> DataFrame:
    """``df`` with the spans of all layers, with the entity layer behind the field gate."""
    rows = predicted(df, "field_gated", ner, text, log_type, out)
    return rows.withColumn(out, F.concat(F.col(out), scan_entropy(F.col(text)), *([scan_flattened_names(F.col(text))] if flattened else [])))
