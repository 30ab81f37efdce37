"""Plumbing that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.sources.lineage import cut, cut_few, shared_folder  # noqa: F401
from veilspan.sources.readers import spread  # noqa: F401

#: Arrow batches handed to Python hold at most so many rows and bytes, whatever the length of the texts.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Python workers' memory bounded for long texts too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_kept: tuple[object, object] = (None, None)


def kept_by_worker(name: object = None, make=lambda: None):
    """What ``make`` made for this name, kept in the Python worker from batch to batch and task to task. A worker keeps one
    such thing: when it comes to work for another operator, the earlier one's memory is given back first."""
    global _kept
    if _kept[0] != name:
        _kept = (None, None)
        give_back()
        _kept = (name, make())
    return _kept[1]


def give_back() -> None:
    """Returns memory that this process no longer uses (a fitted sample, another operator's words, Arrow batches) to the system,
    where the C library can."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Recent(dict):
    """A bounded mapping that ``make`` fills when a key is first asked for. Keys live in two generations: what was asked for
    since the last turn, and what was before it; what nobody asked for in both is forgotten. Long keys are never kept."""

    def __init__(self, make, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.most // 2:
            self.older = dict(self)
            self.clear()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the number as decimal text, modulo ``modulus``; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hash_unit(*columns: Column, seed: int = 0) -> Column:
    """A reproducible pseudorandom number in [0, 1) from the columns' values."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


#: A key is hot if it holds more than so many rows and than twice a partition's fair share of all rows.
LEAST_HOT = 200


def joined(left: DataFrame, right: DataFrame, key: str, rows: str | None = None, how: str = "inner", total: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key, so that no hot key's rows of ``left`` meet in one task:
    they are dealt into pieces, and the key's row of ``right`` is repeated for each piece. Hot keys are at most half as many
    as partitions, so their list may be broadcast. ``rows`` names a column of ``right`` with each key's number of rows in
    ``left`` (it is dropped); without it they are counted, pre-aggregated, in ``left`` or in
    ``counted``, a table with as many rows of each key that costs less to read. ``total``: the rows of ``left``, where known."""
    counts = right.select(key, F.col(rows).alias("_veil_rows")) if rows else (left if counted is None else counted).groupBy(key).agg(F.count("*").alias("_veil_rows"))
    if rows:
        right = right.drop(rows)
    n = total
    if n is None:
        n = left.count() if rows is None else counts.agg(F.sum("_veil_rows")).first()[0] or 0
    share = max(LEAST_HOT // 2, -(-n // partitions(left.sparkSession)))
    hot = counts.where(F.col("_veil_rows") > 2 * share).select(key, F.ceil(F.col("_veil_rows") / share).cast("int").alias("_veil_pieces"))
    hot = F.broadcast(hot)
    piece = F.coalesce(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns], F.lit(17)), F.col("_veil_pieces")), F.lit(0)).cast("int")
    dealt = left.join(hot, key, "left").withColumn("_veil_piece", piece).drop("_veil_pieces")
    # every row of right once, as piece 0, and those of hot keys once for each further piece
    others = right.join(hot, key).withColumn("_veil_piece", F.explode(F.sequence(F.lit(1), F.col("_veil_pieces") - 1))).drop("_veil_pieces")
    repeated = right.withColumn("_veil_piece", F.lit(0)).unionByName(others)
    return dealt.join(repeated, [key, "_veil_piece"], how).drop("_veil_piece")


#: A sample to fit a classifier on has about so many rows at most, whatever the number of labels.
SAMPLE_ROWS = 20_000


def labelled_sample(rows: DataFrame, label: str, per_label: int, kept: dict[str, Column], identity: list[Column]) -> list:
    """Driver-side rows of label, ``_veil_hash`` and the ``kept`` columns: about ``per_label`` of each label (all of a rarer one;
    fewer if there are so many labels that ``SAMPLE_ROWS`` would be exceeded, the rarest of more than ``SAMPLE_ROWS`` labels
    getting none). Null labels never are in it.

    Rows are drawn by a hash of their ``identity`` (which should tell rows apart, as id and text together do), against the
    number of different ones of each label: a hot or null id is drawn from like any other, and rows that are equal
    throughout count as one. The sample is the same in every run.
    """
    known = rows.where(F.col(label).isNotNull()).withColumn("_veil_hash", F.xxhash64(*identity, F.lit(7)))
    counts = known.groupBy(label).agg(F.approx_count_distinct("_veil_hash", 0.02).alias("n"))
    counts = counts.orderBy(F.desc("n"), label).limit(SAMPLE_ROWS).collect()
    if not counts:
        return []
    each = min(per_label, max(1, SAMPLE_ROWS // len(counts)))
    # a little more than wanted is drawn, and cut to size here
    shares = known.sparkSession.createDataFrame([(value, min(1.0, (1.1 * each + 3 * each**0.5) / max(1, n))) for value, n in counts], known.select(label).schema.add("_veil_share", "double"))
    unit = F.pmod(F.xxhash64("_veil_hash", F.lit(8)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = known.join(F.broadcast(shares), label).where(unit < F.col("_veil_share")).select(label, "_veil_hash", *[c.alias(n) for n, c in kept.items()])
    drawn = drawn.groupBy(label, "_veil_hash").agg(*[F.first(n).alias(n) for n in kept]).collect()
    drawn.sort(key=lambda r: (str(r[label]), r["_veil_hash"]))
    out, of = [], {}
    for r in drawn:
        of[r[label]] = of.get(r[label], 0) + 1
        if of[r[label]] <= each:
            out.append(r)
    return out


#: A text's share in a sample: as many pieces from its whole length, of so many code points each.
PIECES, PIECE_CHARS = 6, 1000


def spread_pieces(text: Column) -> Column:
    """At most PIECES * PIECE_CHARS code points of a text, in pieces spread evenly over its whole length."""
    n = F.length(text)
    gap = F.greatest(F.lit(PIECE_CHARS), F.floor((n - PIECE_CHARS) / (PIECES - 1))).cast("int")
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: i * gap), lambda s: s < F.greatest(n, F.lit(1)))
    return F.when(n > PIECES * PIECE_CHARS, F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(PIECE_CHARS)))).otherwise(F.array(text))


def constants(values: list, kind: str = "bigint") -> Column:
    """A list of driver-side numbers as one folded literal (not one expression per number)."""
    import json

    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def interval_of(ends: list[int], x: Column) -> Column:
    """Index of the first of the ascending exclusive ``ends`` that is over ``x``, their number if none is; looked up in two
    steps of about the square root of their number."""
    import json
    import math

    step = max(1, math.isqrt(len(ends)))
    parts = [ends[i : i + step] for i in range(0, len(ends), step)]
    last = constants([p[-1] for p in parts])
    nested = F.from_json(F.lit(json.dumps(parts)), "array<array<bigint>>")
    below = lambda array: F.size(F.filter(array, lambda e: e <= x))
    return F.least(let(below(last), lambda i: i * step + F.coalesce(below(F.get(nested, i)), F.lit(0))), F.lit(len(ends))).cast("int")
