"""Detectors: regular expressions, entropy, flattened names and named entities, and their ensembles.

Each gives an array of spans (functions.spans) for a text column; ensembles concatenate them in the fixed order regex,
named entities, entropy, names, which later steps rely on. Null texts have no spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.spans import SPANS_TYPE, find_all, let, no_spans, span

#: An expression that finds named entities in a text column.
NerProvider = Callable[[Column], Column]


def _account_id(text: Column, start: Column) -> Column:
    """Whether what precedes a number says that it is a cloud account's id. Nothing is looked at but in texts that hold one of
    the words that both contexts begin with."""
    return F.when(F.contains(text, F.lit(P.ACCOUNT_ID_WORDS[0])) | F.contains(text, F.lit(P.ACCOUNT_ID_WORDS[1])), let(F.substring(text, F.lit(1), start), lambda before: before.rlike("|".join(P.ACCOUNT_ID_CONTEXT)))).otherwise(False)


def scan_regex(text: Column, types: tuple[str, ...] = tuple(P.REGEX_PATTERNS)) -> Column:
    """Layer 1: SSN, EMAIL, CREDIT_CARD, IP, MRN, in this order and then by position."""

    def make(kind: str) -> Callable[[Column, Column, Column], Column]:
        def hit(match: Column, start: Column, end: Column) -> Column:
            found = span(kind, start, end, "regex")
            if kind != "CREDIT_CARD":
                return found
            return F.when(~((end - start == P.ACCOUNT_ID_LENGTH) & _account_id(text, start)), found)

        return hit

    return F.coalesce(F.concat(*[find_all(text, P.UNICODE + pattern, make(kind)) for kind, pattern in P.REGEX_PATTERNS.items() if kind in types]), no_spans())


def shannon_entropy(token: Column) -> Column:
    """Bits per code point; 0 for an empty token. Counted over the sorted characters in one pass."""
    n = F.length(token).cast("double")
    chars = F.array_sort(F.split(token, ""))
    start = F.struct(F.lit("").alias("char"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

    def close(s: Column) -> Column:
        return s["sum"] - F.when(s["run"] > 0, s["run"] / n * F.log2(s["run"] / n)).otherwise(0.0)

    def step(s: Column, c: Column) -> Column:
        same = s["char"] == c
        return F.struct(c.alias("char"), F.when(same, s["run"] + 1).otherwise(1).alias("run"), F.when(same, s["sum"]).otherwise(close(s)).alias("sum"))

    return F.when(F.length(token) > 0, F.aggregate(chars, start, step, close)).otherwise(F.lit(0.0))


def scan_entropy(text: Column, min_len: int = P.ENTROPY_MIN_LENGTH, threshold: float = P.ENTROPY_THRESHOLD, uuids: bool = False) -> Column:
    """Layer 3: tokens of at least ``min_len`` characters and ``threshold`` bits, without those that hold a UUID (unless
    ``uuids``)."""

    def hit(match: Column, start: Column, end: Column) -> Column:
        return F.when(
            (F.length(match) >= min_len) & (F.lit(uuids) | ~match.rlike(P.UUID)),
            let(shannon_entropy(match), lambda h: F.when(h >= threshold, span(P.HIGH_ENTROPY, start, end, "entropy", entropy=F.round(h, 2)))),
        )

    return F.coalesce(find_all(text, P.ENTROPY_TOKEN, hit), no_spans())


def _names(first: tuple[str, ...], last: tuple[str, ...]) -> tuple[str, str]:
    fit = lambda names: "|".join(sorted({n.lower() for n in names if len(n) >= P.MIN_NAME_PART}))
    return fit(first), fit(last)


def name_patterns(first: tuple[str, ...] = P.FIRST_NAMES, last: tuple[str, ...] = P.LAST_NAMES) -> tuple[str, str]:
    """Two patterns for a lower-case token: names with one separator between, and names without. For dictionaries of up to
    a few thousand names; ``flattened_names_by_join`` takes any size."""
    f, l = _names(first, last)
    return rf"^(?:(?:{f})[._-](?:{l})|(?:{l})[._-](?:{f}))$", rf"^(?:(?:{f})(?:{l})|(?:{l})(?:{f}))$"


def _name_token(text: Column, hit: Callable[[Column, Column, Column], Column]) -> Column:
    """Spans of the name tokens that no ``@`` follows."""

    def make(match: Column, start: Column, end: Column) -> Column:
        # the dictionary first: looking at the next character walks the text
        return let(hit(match, start, end), lambda s: F.when(s.isNotNull() & (F.substring(text, end + 1, F.lit(1)) != "@"), s))

    return F.coalesce(find_all(text, P.UNICODE + P.NAME_TOKEN, make), no_spans())


def _core(token: Column) -> Column:
    """A token without separators loses its trailing digits; one with separators stays."""
    return F.when(token.rlike("[._-]"), token).otherwise(F.regexp_replace(token, r"(?U)\d+$", ""))


def scan_flattened_names(text: Column, first: tuple[str, ...] = P.FIRST_NAMES, last: tuple[str, ...] = P.LAST_NAMES) -> Column:
    """Layer 4: user-name tokens made of a first and a last name in either order."""
    separated, joined = name_patterns(first, last)

    def hit(match: Column, start: Column, end: Column) -> Column:
        def of_core(core: Column) -> Column:
            fits = F.when(core.rlike("[._-]"), core.rlike(separated)).otherwise((F.length(core) >= P.MIN_NAME_TOKEN) & core.rlike(joined))
            return F.when(fits, span("PERSON", start, start + F.length(core), "flattened_name_dict"))

        return let(F.lower(_core(match)), of_core)  # tokens are ASCII, so lower case has their length

    return _name_token(text, hit)


def flattened_names_by_join(df: DataFrame, names: DataFrame, line_id: str = "line_id", text: str = "text") -> DataFrame:
    """Layer 4 against a dictionary table (name, is_first, is_last) of any size: line_id, start, end.

    Tokens are split at every place and joined with the dictionary twice; small dictionaries are broadcast by their size.
    """
    tokens = df.select(F.col(line_id).alias("line_id"), F.inline(_name_token(F.col(text), lambda m, s, e: span(_core(m), s, s + F.length(_core(m)), "token"))))
    tokens = tokens.select("line_id", "start", "end", F.lower("type").alias("token"))
    parts = F.split("token", "[._-]")
    separated = F.when((F.size(parts) == 2), F.array(F.struct(F.get(parts, F.lit(0)).alias("left"), F.get(parts, F.lit(1)).alias("right"))))
    places = F.sequence(F.lit(P.MIN_NAME_PART), F.length("token") - P.MIN_NAME_PART)
    joined = F.when(F.length("token") >= P.MIN_NAME_TOKEN, F.transform(places, lambda k: F.struct(F.substring("token", F.lit(1), k).alias("left"), F.substring("token", k + 1, F.length("token")).alias("right"))))
    splits = tokens.select("line_id", "start", "end", F.inline(F.when(F.col("token").rlike("[._-]"), separated).otherwise(joined)))
    splits = splits.where((F.length("left") >= P.MIN_NAME_PART) & (F.length("right") >= P.MIN_NAME_PART))
    known = names.groupBy(F.lower("name").alias("name")).agg(F.max("is_first").alias("is_first"), F.max("is_last").alias("is_last"))
    left = known.withColumnsRenamed({"name": "left", "is_first": "left_first", "is_last": "left_last"})
    right = known.withColumnsRenamed({"name": "right", "is_first": "right_first", "is_last": "right_last"})
    found = splits.join(left, "left").join(right, "right").where("(left_first and right_last) or (left_last and right_first)")
    return found.select("line_id", "start", "end").distinct()


def could_hold_entity(text: Column) -> Column:
    """False only for texts that can hold no entity: no two letters and no two digits in a row."""
    return text.rlike(P.UNICODE + P.EARLY_EXIT)


def rule_ner(first: tuple[str, ...] = P.FIRST_NAMES, last: tuple[str, ...] = P.LAST_NAMES, min_score: float = P.NER_MIN_SCORE) -> NerProvider:
    """The default provider, in place of a model: capitalised first and last names from the dictionary with a space between,
    and the five patterns. Its quality is its own and says nothing about any model's."""
    capital = lambda names: "|".join(sorted(n.capitalize() for n in names))
    person = rf"\b(?:{capital(first)}) (?:{capital(last)})\b"
    scores = {"SSN": 0.85, "EMAIL": 1.0, "CREDIT_CARD": 0.6, "IP": 0.95, "MRN": 0.9, "PERSON": 0.85}

    def scan(text: Column) -> Column:
        found = [find_all(text, P.UNICODE + (person if k == "PERSON" else P.REGEX_PATTERNS[k]), lambda m, s, e, k=k: span(k, s, e, "ner", score=F.lit(score))) for k, score in scores.items() if score >= min_score]
        return F.coalesce(F.when(could_hold_entity(text), F.concat(*found)), no_spans())

    return scan


def model_ner(load: Callable[[], Callable[[str], list[tuple[str, int, int, float]]]], min_score: float = P.NER_MIN_SCORE) -> NerProvider:
    """A provider from a model: ``load()`` is called once in each worker and gives a function from a text to (type, start,
    end, score) tuples. Runs as an Arrow UDF; texts that can hold no entity never reach it."""
    import pandas as pd
    from pyspark.sql import types as T

    fields = [("type", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("method", T.StringType()), ("score", T.DoubleType()), ("entropy", T.DoubleType())]
    schema = T.ArrayType(T.StructType([T.StructField(*f) for f in fields]))

    def run(batches):
        analyze = load()
        for texts in batches:
            yield pd.Series([
                [{"type": t, "start": s, "end": e, "method": "ner", "score": round(score, 3), "entropy": None} for t, s, e, score in (analyze(x) if x else []) if score >= min_score]
                for x in texts
            ])

    from collections.abc import Iterator

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, schema)
    return lambda text: F.coalesce(udf(F.when(could_hold_entity(text), text)).cast(SPANS_TYPE), no_spans())


#: Entity names of the optional model and their types.
ENTITY_TYPES = {"PERSON": "PERSON", "EMAIL_ADDRESS": "EMAIL", "IP_ADDRESS": "IP", "US_SSN": "SSN", "CREDIT_CARD": "CREDIT_CARD", "MEDICAL_RECORD_NUMBER": "MRN"}


def load_presidio(with_mrn: bool = True) -> Callable[[str], list[tuple[str, int, int, float]]]:
    """The optional model, where presidio-analyzer is installed; without ``with_mrn`` its own defaults alone."""
    from presidio_analyzer import AnalyzerEngine, Pattern, PatternRecognizer

    engine = AnalyzerEngine()
    if with_mrn:
        engine.registry.add_recognizer(PatternRecognizer(supported_entity="MEDICAL_RECORD_NUMBER", patterns=[Pattern(name="mrn", regex=P.REGEX_PATTERNS["MRN"], score=0.9)]))
    wanted = [e for e in ENTITY_TYPES if with_mrn or e != "MEDICAL_RECORD_NUMBER"]
    return lambda text: [(ENTITY_TYPES[r.entity_type], r.start, r.end, r.score) for r in engine.analyze(text=text, language="en", entities=wanted)]


def without_entropy(spans: Column) -> Column:
    """What goes on to anonymization: everything but high-entropy tokens."""
    return F.filter(spans, lambda s: s["type"] != P.HIGH_ENTROPY)


def detect_all(text: Column, ner: NerProvider | None = None, flattened: bool = True) -> Column:
    """All layers over the whole text: regex, named entities (where a provider is given), entropy, names."""
    layers = [scan_regex(text), *([ner(text)] if ner else []), scan_entropy(text), *([scan_flattened_names(text)] if flattened else [])]
    return F.concat(*layers)
