"""Span folds and detectors against plain-Python models and literal cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.spans import SPANS_TYPE, dedup_by_emission, dedup_by_start, find_all, has_type_collision, match, replace_right_to_left, span
from veilspan.operators import detect, evaluate, gate


def rows_of(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def plain(spans):
    return [(s["type"], s["start"], s["end"]) for s in spans]


@pytest.mark.parametrize("pattern", [*P.REGEX_PATTERNS.values(), P.ENTROPY_TOKEN, P.NAME_TOKEN])
def test_offsets_equal_finditer(spark, pattern):
    random.seed(3)
    pool = ["a.b+c@ex-am.org", "123-45-6789", "MRN-1234567", "10.0.0.1", "4111111111111111", "é", "日本", "٣", "😀", " ", "\n", "-", "john.smith", "x1", "_", "token=abcDEF0123456789", "."]
    texts = ["".join(random.choice(pool) for _ in range(random.randint(0, 12))) for _ in range(300)]
    got = rows_of(spark, texts, find_all(F.col("t"), P.UNICODE + pattern, lambda m, s, e: span("X", s, e, "m")))
    assert [[(s["start"], s["end"]) for s in g] for g in got] == [[m.span() for m in re.finditer(pattern, t)] for t in texts]


CASES = [
    ('{"owner": {"accountId": "730022914466"}}', 0),
    ('{"role": "arn:aws:iam::730022914466:role/reader"}', 0),
    ('{"role": "arn:aws-cn:sts:eu-west-9:730022914466:assumed"}', 0),
    ('{"recipientAccountId" :  "730022914466"}', 0),
    ("paid with 520000111122 yesterday", 1),
    ('{"role": "arn:aws:iam::5200001111223344:role/reader"}', 1),
    ('{"orderNumber": "730022914466"}', 1),
    ('{"accountId": 730022914466}', 1),
    ("x730022914466.dsl.example.net", 0),
]


def test_account_ids_are_no_cards(spark):
    got = rows_of(spark, [c[0] for c in CASES], F.size(F.filter(detect.scan_regex(F.col("t")), lambda s: s["type"] == "CREDIT_CARD")))
    assert got == [c[1] for c in CASES]


def test_regex_emission_order_and_nulls(spark):
    got = rows_of(spark, ["10.0.0.1 a@b.co 123-45-6789", None, ""], detect.scan_regex(F.col("t")))
    assert plain(got[0]) == [("SSN", 16, 27), ("EMAIL", 9, 15), ("IP", 0, 8)]
    assert got[1] == [] and got[2] == []


def test_early_exit(spark):
    texts = ["", "   ", "---", ".", "a b c", "42", "PING"]
    assert rows_of(spark, texts, detect.could_hold_entity(F.col("t"))) == [False] * 5 + [True] * 2


def test_flattened_names(spark):
    texts = ["user johnsmith42 in", "john.smith", "john.smith42", "smithjohn", "johnsmith@ex.com", "josmi", "john.smith+x@ex.com", "JohnSmith"]
    got = [plain(g) for g in rows_of(spark, texts, detect.scan_flattened_names(F.col("t")))]
    assert got == [[("PERSON", 5, 14)], [("PERSON", 0, 10)], [], [("PERSON", 0, 9)], [], [], [("PERSON", 0, 10)], [("PERSON", 0, 9)]]


def test_entropy_and_uuid(spark):
    texts = ["k=aB3dE5gH7jK9mN1pQ", "123e4567-e89b-12d3-a456-426614174000", "aaaaaaaaaaaaaaaa", None]
    got = rows_of(spark, texts, detect.scan_entropy(F.col("t")))
    assert [len(g) for g in got] == [1, 0, 0, 0] and got[0][0]["entropy"] == pytest.approx(4.25)  # 19 different characters
    assert rows_of(spark, ["", "abab"], detect.shannon_entropy(F.col("t"))) == [0.0, 1.0]


def test_folds_against_models(spark):
    random.seed(5)

    def spans(n):
        out = []
        for _ in range(n):
            start = random.randint(0, 30)
            out.append((random.choice("AB"), start, start + random.randint(1, 8), "m", None, None))
        return out

    data = [(i, spans(random.randint(0, 6)), spans(random.randint(0, 6)), "é😀abcdefghijklmnopqrstuvwxyz0123456789ABCDEF") for i in range(200)]
    df = spark.createDataFrame(data, f"i int, a {SPANS_TYPE}, b {SPANS_TYPE}, t string")
    got = df.select(
        "i", dedup_by_start(F.col("a")).alias("by_start"), dedup_by_emission(F.col("a")).alias("by_emission"), match(F.col("a"), F.col("b")).alias("pairs"),
        match(F.col("a"), F.col("b"), same_type=False).alias("any"), replace_right_to_left(F.col("t"), F.col("a"), lambda o, s: F.concat(F.lit("<"), o, F.lit(">"))).alias("replaced"),
        has_type_collision(F.col("a")).alias("collision"),
    ).orderBy("i").collect()
    over = lambda x, y: x[1] < y[2] and y[1] < x[2]

    def greedy(spans):
        kept = []
        for s in spans:
            if not any(k[0] == s[0] and over(k, s) for k in kept):
                kept.append(s)
        return kept

    def pairs(outer, inner, same):
        used, out = set(), []
        for i, o in enumerate(outer):
            for j, s in enumerate(inner):
                if j not in used and over(o, s) and (not same or o[0] == s[0]):
                    used.add(j)
                    out.append((i, j))
                    break
        return out

    for (_, a, b, t), r in zip(data, got, strict=True):
        assert [tuple(s) for s in r["by_start"]] == greedy(sorted(a, key=lambda s: s[1]))
        assert [tuple(s) for s in r["by_emission"]] == greedy(a)
        assert [tuple(p) for p in r["pairs"]] == pairs(a, b, True)
        assert [tuple(p) for p in r["any"]] == pairs(a, b, False)
        out = t
        for s in sorted(greedy(sorted(a, key=lambda s: s[1])), key=lambda s: -s[1]):
            out = out[: s[1]] + "<" + out[s[1] : s[2]] + ">" + out[s[2] :]
        assert r["replaced"] == out
        assert r["collision"] == any(x[0] != y[0] and over(x, y) for x in a for y in a)


def candidate(spark, log_type, texts):
    df = spark.createDataFrame([(i, t, log_type) for i, t in enumerate(texts)], "i int, log string, log_type string")
    return [r["c"] for r in gate.with_candidate(df).select("i", F.col("_veil_gated").alias("c")).orderBy("i").collect()]


def test_field_gate(spark):
    text = "Owner=Sarah Young Tax=321-54-9876"
    c = candidate(spark, "windows_event", [text])[0]
    assert c["candidate"] == "Owner=Sarah Young " and len(c["segments"]) == 1
    assert candidate(spark, "windows_event", ["From=172.16.0.4 To=172.16.0.8"])[0]["candidate"] is None
    free = "tax number 321-54-9876"
    assert candidate(spark, "other", [free])[0]["candidate"] == free and candidate(spark, None, [free])[0]["candidate"] == free
    line = "ftpd[77]: login refused; host=172.16.0.4 user=guest"
    c = candidate(spark, "syslog", [line])[0]["candidate"]
    assert "host=" not in c and "user=guest" in c
    # a value that stands in the line before its own field: the walk goes on from where the field before ended
    line = '{"a": "x y", "b": "10.1.1.1", "c": "x y"}'
    assert candidate(spark, "cloudtrail", [line])[0]["candidate"] == '{"a": "x y", "b": "", "c": "x y"}'


def test_remap_two_segments(spark):
    text = "Owner=Sarah Young From=172.16.0.4 Backup=Sarah Young"
    df = spark.createDataFrame([(text, "windows_event")], "log string, log_type string")
    got = gate.detect_field_gated(df, detect.rule_ner(), flattened=False).first()["spans"]
    people = [(s["start"], s["end"]) for s in got if s["type"] == "PERSON"]
    assert [text[a:b] for a, b in people] == ["Sarah Young"] * 2 and people[1][0] == text.rindex("Sarah")


def stub_model():
    """Stands for a model: every word in capitals is a person, of a score by its length."""
    return lambda text: [("PERSON", m.start(), m.end(), len(m[0]) / 10) for m in re.finditer(r"\b[A-Z]{2,}\b", text)]


def test_a_model_behind_every_strategy(spark):
    ner = detect.model_ner(stub_model, min_score=0.4)
    rows = [(0, "user=ALICE BO host=10.0.0.1 note=CARLOS", "windows_event"), (1, "DIANA", "other"), (2, "--", "other"), (3, None, "other"), (4, "from=10.0.0.1", "windows_event")]
    df = spark.createDataFrame(rows, "i int, log string, log_type string")

    def people(strategy):
        found = gate.predicted(df, strategy, ner).orderBy("i").collect()
        return [[(r["log"][s["start"] : s["end"]], s["score"]) for s in r["pred"] if s["type"] == "PERSON"] for r in found]

    every = [[("ALICE", 0.5), ("CARLOS", 0.6)], [("DIANA", 0.5)], [], [], []]  # BO is too short a name for the score
    assert people("naive") == people("naive_flattened") == people("field_gated") == every
    assert people("tiered") == [[], [("DIANA", 0.5)], [], [], []] and people("regex_only") == [[]] * 5
    assert len(detect.detect_all(F.col("log"), ner)._jc.toString()) > 0
    assert [len(r[0]) for r in df.select(detect.detect_all(F.col("log"), ner)).collect()] == [3, 1, 0, 0, 1]
    with pytest.raises(ValueError):
        gate.predicted(df, "none", ner)


def test_adapter_of_the_optional_model(monkeypatch):
    """The package is not installed: a stand-in answers as its engine does."""
    import sys
    import types

    asked = []

    class Engine:
        def __init__(self):
            self.registry = types.SimpleNamespace(add_recognizer=lambda r: asked.append(r))

        def analyze(self, text, language, entities):
            asked.append((language, tuple(entities)))
            return [types.SimpleNamespace(entity_type="EMAIL_ADDRESS", start=0, end=len(text), score=0.8)]

    make = lambda **values: types.SimpleNamespace(**values)
    monkeypatch.setitem(sys.modules, "presidio_analyzer", types.SimpleNamespace(AnalyzerEngine=Engine, Pattern=make, PatternRecognizer=make))
    assert detect.load_presidio()("abc") == [("EMAIL", 0, 3, 0.8)]
    assert asked[0].supported_entity == "MEDICAL_RECORD_NUMBER" and asked[1] == ("en", tuple(detect.ENTITY_TYPES))
    asked.clear()
    detect.load_presidio(with_mrn=False)("abc")
    assert len(asked) == 1 and "MEDICAL_RECORD_NUMBER" not in asked[0][1]


def test_confusion_equals_greedy_matching(spark):
    """Also where spans of one type overlap several labelled ones, and the other way round."""
    random.seed(9)

    def some():
        out = []
        for _ in range(random.randint(0, 5)):
            start = random.randint(0, 25)
            out.append((random.choice("AB"), start, start + random.randint(1, 9), "m", None, None))
        return out

    rows = [(some(), some()) for _ in range(300)]
    df = spark.createDataFrame(rows, f"gold {SPANS_TYPE}, pred {SPANS_TYPE}")
    over = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
    for outer in ("gold", "pred"):
        want = {k: [0, 0, 0] for k in "AB"}
        for gold, pred in rows:
            kept = []
            for p in pred:
                if not any(over(p, k) for k in kept):
                    kept.append(p)
            lead, follow = (gold, kept) if outer == "gold" else (kept, gold)
            used = set()
            hits = 0
            for o in lead:
                j = next((j for j, s in enumerate(follow) if j not in used and over(o, s)), None)
                if j is not None:
                    used.add(j)
                    want[o[0]][0] += 1
                    hits += 1
            for k in "AB":
                want[k][1] += sum(p[0] == k for p in kept)
                want[k][2] += sum(g[0] == k for g in gold)
        got = {r["type"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.confusion(df, outer=outer).collect()}
        assert got == {k: (tp, pred - tp, gold - tp) for k, (tp, pred, gold) in want.items()}


def test_metrics_without_denominator(spark):
    counts = spark.createDataFrame([("A", 0, 0, 3), ("B", 2, 1, 0)], "type string, tp long, fp long, fn long")
    got = {r["type"]: r for r in evaluate.metrics(counts).collect()}
    assert got["A"]["precision"] == 0 and got["A"]["f1"] == 0 and got["MICRO-AVG"]["tp"] == 2 and got["MICRO-AVG"]["recall"] == 0.4
