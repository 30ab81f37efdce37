"""Spans in text: code-point offsets, half open, as array<struct> columns, and the folds over them.

Everything here is a column expression of built-in functions: no Python runs on executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_TYPE = "struct<type:string,start:int,end:int,method:string,score:double,entropy:double>"
SPANS_TYPE = f"array<{SPAN_TYPE}>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def no_spans() -> Column:
    return F.array().cast(SPANS_TYPE)


def span(type_: Column | str, start: Column, end: Column, method: str, score: Column | None = None, entropy: Column | None = None) -> Column:
    kind = F.lit(type_) if isinstance(type_, str) else type_
    nothing = F.lit(None).cast("double")
    return F.struct(
        kind.alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(method).alias("method"),
        (nothing if score is None else score).alias("score"), (nothing if entropy is None else entropy).alias("entropy"),
    ).cast(SPAN_TYPE)


def find_all(text: Column, pattern: str, make: Callable[[Column, Column, Column], Column]) -> Column:
    """Spans of all leftmost non-overlapping matches: ``make(match, start, end)`` gives a span, or null to leave it out.

    Matches and the gaps between them are extracted once; a running sum of their lengths gives the offsets.
    """
    pieces = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, g: F.struct(m.alias("match"), F.length(g).alias("gap")))
    start = F.struct(F.lit(0).alias("at"), no_spans().alias("found"))

    def step(state: Column, piece: Column) -> Column:
        begin, end = state["at"] + piece["gap"], state["at"] + piece["gap"] + F.length(piece["match"])
        found = let(make(piece["match"], begin, end), lambda s: F.when(s.isNotNull(), F.concat(state["found"], F.array(s))).otherwise(state["found"]))
        return F.struct(end.alias("at"), found.alias("found"))

    found = F.aggregate(F.filter(pieces, lambda p: p["match"].isNotNull()), start, step, lambda s: s["found"])
    return F.when(text.rlike(pattern), found).otherwise(no_spans())


def occurrences(text: Column, value: Column, type_: str, method: str = "gold") -> Column:
    """Spans of every occurrence of a literal value; none for an empty or null one."""
    gaps = F.split(text, F.concat(F.lit("\\Q"), value, F.lit("\\E")), -1)
    start = F.struct(F.lit(0).alias("at"), no_spans().alias("found"))

    def step(state: Column, gap: Column) -> Column:
        begin = state["at"] + F.length(gap)
        return F.struct((begin + F.length(value)).alias("at"), F.concat(state["found"], F.array(span(type_, begin, begin + F.length(value), method))).alias("found"))

    found = F.aggregate(gaps, start, step, lambda s: F.slice(s["found"], 1, F.size(s["found"]) - 1))
    return F.when((F.length(value) > 0) & F.contains(text, value), found).otherwise(no_spans())


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def shifted(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: s.withField("start", s["start"] + by).withField("end", s["end"] + by))


def _stable(spans: Column, descending: bool = False) -> Column:
    """Sorted by start; spans with equal starts keep their order."""
    keyed = F.transform(spans, lambda s, i: F.struct((-s["start"] if descending else s["start"]).alias("key"), i.alias("nth"), s.alias("span")))
    return F.transform(F.sort_array(keyed), lambda k: k["span"])


def _greedy(spans: Column) -> Column:
    def step(kept: Column, s: Column) -> Column:
        return F.when(F.exists(kept, lambda k: (k["type"] == s["type"]) & overlaps(k, s)), kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(spans, no_spans(), step)


def dedup_by_start(spans: Column) -> Column:
    """Spans by start (stable), without those that overlap an earlier kept one of the same type."""
    return _greedy(_stable(spans))


def dedup_by_emission(spans: Column) -> Column:
    """The same in the order in which detectors emitted the spans; not interchangeable with ``dedup_by_start``."""
    return _greedy(spans)


def has_type_collision(spans: Column) -> Column:
    """Whether spans of different types overlap, a case for manual review."""
    return F.exists(spans, lambda a: F.exists(spans, lambda b: (a["type"] != b["type"]) & overlaps(a, b)))


def match(outer: Column, inner: Column, same_type: bool = True) -> Column:
    """Greedy one-to-one matching: each outer span, in order, takes the first unused inner span that overlaps it.

    Gives array<struct<outer:int,inner:int>>, positions from 0. Gold-outer, hit-outer (``same_type=False``) and pred-outer
    evaluation are this with other arguments.
    """
    start = F.array().cast("array<struct<outer:int,inner:int>>")
    numbered = F.transform(outer, lambda s, i: F.struct(i.alias("nth"), s.alias("span")))

    def step(pairs: Column, o: Column) -> Column:
        def fits(s: Column, i: Column) -> Column:
            fit = overlaps(o["span"], s) & ~F.exists(pairs, lambda p: p["inner"] == i)
            return F.when(fit & (o["span"]["type"] == s["type"]) if same_type else fit, i)

        first = F.array_min(F.transform(inner, fits))
        return let(first, lambda i: F.when(i.isNotNull(), F.concat(pairs, F.array(F.struct(o["nth"].alias("outer"), i.alias("inner"))))).otherwise(pairs))

    return F.aggregate(numbered, start, step)


def replace_right_to_left(text: Column, spans: Column, replacement: Callable[[Column, Column], Column]) -> Column:
    """``text`` with each span replaced, from the last to the first, by ``replacement(original, span)``, after
    ``dedup_by_start``. Overlapping spans of different types act on text that is already edited (see has_type_collision)."""

    def step(out: Column, s: Column) -> Column:
        original = F.substring(out, s["start"] + 1, s["end"] - s["start"])
        return F.concat(F.substring(out, F.lit(1), s["start"]), replacement(original, s), F.substring(out, s["end"] + 1, F.length(out)))

    return F.aggregate(_stable(dedup_by_start(spans), descending=True), text, step)


def text_of(text: Column, s: Column) -> Column:
    return F.substring(text, s["start"] + 1, s["end"] - s["start"])
