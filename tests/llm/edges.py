"""A small table with every awkward case: nulls, empty and blank texts, ties, repeated rows, a very long text, other scripts,
and extra columns whose names clash with results."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 997}x{i % 31}" for i in range(30_000))
NO_SPACES = "日本語の文章は空白なしで書かれています。" * 40
PLAIN = "the quick brown fox jumps over the lazy dog and then it runs home to sleep until morning comes again"
ROWS = [
    (1, PLAIN, "en", "b"), (2, None, None, None), (3, "", "en", "a"), (4, "  \n\t", None, "a"), (5, PLAIN, "en", "b"), (5, PLAIN, "en", "b"),
    (6, LONG, "en", "b"), (7, NO_SPACES, "ja", "c"), (8, "!!! ... ###", "en", "b"), (9, "x", "en", None), (None, "no id here at all but some words", "en", "b"),
    (10, "émile zölä ça où ß İ Σ 😀 " * 3, "fr", "b"), (11, PLAIN + " really", "en", "b"), (12, "a" * 5000, "en", "b"),
]


def table(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    clash = {c: F.lit("own") for c in ("score", "media", "shard", "slot", "size", "taken", "row", "bucket", "node", "key", "number", "range", "guest", "sketch", "held_out", "label", "words")}
    return df.withColumns(clash)


def empty(spark: SparkSession) -> DataFrame:
    return table(spark).limit(0)
