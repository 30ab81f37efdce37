"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents are laid end to end and cut into blocks of ``BLOCK`` words. The mix is a row of slots, dealt into
output shards. Each shard draws multinomial source counts (every slot an independent draw with the target shares); the
slots that a source drew over its quota are dealt again to the sources that drew short, so that totals meet the targets.
A source's slots are numbered; slot r takes block permutation(r mod blocks) of epoch r div blocks, where each source and
epoch has its own pseudorandom permutation of the block numbers (swap-or-not: works for any number of blocks). Drawn
blocks are joined to documents by source and block number. As an epoch takes every block once and there are at most
three, no document is taken more than ``MOST_REPEATS`` times.

Only word counts are shuffled, never texts. A source's layout is numbered within hashed buckets of about
``BUCKET_ROWS`` documents, so that a source with a third of all rows is spread like the others.

Defined cases: null and blank texts have size 0 and nothing taken of them; a null source is a source of its own, last;
repeated rows are documents of their own; an empty table gives no rows; reruns give the same result. More than
``MOST_SOURCES`` sources raise ``ValueError``: the driver holds a few numbers for each. Shards grow beyond ``SHARD_SLOTS``
blocks once there are ``MOST_SHARDS`` of them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.llm.common import constants, cut, hash_unit, interval_of, let, partitions

WEIGHTS, MOST_REPEATS = (5, 2, 1), 3
BLOCK, SHARD_SLOTS, MOST_SHARDS, BUCKET_ROWS = 64, 1024, 65_536, 10_000
#: Sources that the driver and the plans can hold.
MOST_SOURCES = 100_000
#: Rounds of the permutation, and the seeds of the draws and of the permutations.
ROUNDS, DRAW_SEED, ORDER_SEED = 18, 101, 202
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights=WEIGHTS, most: int = MOST_REPEATS) -> list[float]:
    """Each source's words in the mix: shares of all words by weight, at most ``most`` times the source's size; what is
    over is shared again by weight among the others."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, active, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while active:
        total = sum(weight[i] for i in active)
        over = [i for i in active if rest * weight[i] / total > most * sizes[i]]
        if not over:
            for i in active:
                out[i] = rest * weight[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        rest -= sum(out[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return out


def quotas(sizes: list[int], wanted: list[float], most: int = MOST_REPEATS) -> tuple[list[int], list[int]]:
    """Blocks of each source, and its slots in the mix: whole numbers by largest remainder."""
    blocks = [-(-s // BLOCK) for s in sizes]
    exact = [t * b / s if s else 0.0 for s, t, b in zip(sizes, wanted, blocks, strict=True)]
    slots = [min(int(e), most * b) for e, b in zip(exact, blocks, strict=True)]
    by_rest = sorted(range(len(sizes)), key=lambda i: (slots[i] - exact[i], i))
    for i in by_rest[: max(0, round(sum(exact)) - sum(slots))]:
        slots[i] += slots[i] < most * blocks[i]
    return blocks, slots


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Place of ``x`` in the pseudorandom permutation of 0 .. n-1 that ``key`` names (swap-or-not)."""

    def round_(x: Column, i: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*key, i, F.lit(ORDER_SEED)), n) - x, n)
        return let(mirror, lambda y: F.when(F.pmod(F.xxhash64(F.greatest(x, y), *key, i), F.lit(2)) == 0, y).otherwise(x))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, round_)


class Mix:
    """The mix of a table: ``light`` has a row per document without its text."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, key: Column | None = None):
        self.spark = docs.sparkSession
        extra = [] if key is None else [key.alias("key")]
        self.light = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), *extra))
        found = self.light.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()  # a row per source
        if len(found) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
        self.sizes, self.rows = [r["size"] for r in found], [r["rows"] for r in found]
        self.targets = targets(self.sizes, weights)
        self.blocks, self.slots = quotas(self.sizes, self.targets)
        rows = [
            {"number": i, "source": r["source"], "source_size": r["size"], "target": t, "buckets": -(-r["rows"] // BUCKET_ROWS)}
            for i, (r, t) in enumerate(zip(found, self.targets, strict=True))
        ]
        self.sources = self.spark.range(1).select(
            F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<number:int,source:string,source_size:bigint,target:double,buckets:int>>"))
        )

    def drawn_slots(self) -> DataFrame:
        """The mix itself: shard, source's number, epoch and block of every slot."""
        total = sum(self.slots)
        if not total:
            return self.spark.createDataFrame([], "shard long, number int, epoch long, block long")
        ends = [sum(self.slots[: i + 1]) for i in range(len(self.slots))]
        per_shard = max(SHARD_SLOTS, -(-total // MOST_SHARDS))
        draw = interval_of(ends, F.pmod(F.xxhash64("id", F.lit(DRAW_SEED)), F.lit(total)))
        counts = self.spark.range(total).select(F.floor(F.col("id") / per_shard).alias("shard"), draw.alias("number")).groupBy("shard", "number").agg(F.count("*").alias("drawn"))
        counts = cut(counts)
        before = F.coalesce(F.sum("drawn").over(W.partitionBy("number").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        got = dict(counts.groupBy("number").agg(F.sum("drawn")).collect())  # a row per source
        got = [got.get(i, 0) for i in range(len(self.slots))]
        over, short = [max(0, g - s) for g, s in zip(got, self.slots, strict=True)], [max(0, s - g) for g, s in zip(got, self.slots, strict=True)]
        over_from, short_ends = [sum(over[:i]) for i in range(len(over))], [sum(short[: i + 1]) for i in range(len(short))]
        # the window's output is small enough to end in a single task; its slots are not
        spread = counts.withColumn("before", before).repartition(partitions(self.spark), "shard", "number")
        slots = spread.select("shard", "number", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("drawn") - 1)).alias("r"))

        at = lambda values, i: F.get(constants(values), i)
        surplus = at(over_from, F.col("number")) + F.col("r") - at(self.slots, F.col("number"))
        slots = slots.withColumn("surplus", F.when(F.col("r") >= at(self.slots, F.col("number")), surplus))
        slots = slots.withColumn("taker", F.when(F.col("surplus").isNotNull(), interval_of(short_ends, F.col("surplus"))))
        again = at(got, F.col("taker")) + F.col("surplus") - (at(short_ends, F.col("taker")) - at(short, F.col("taker")))
        slots = slots.select("shard", F.coalesce("taker", "number").alias("number"), F.coalesce(again, F.col("r")).alias("r"))
        slots = slots.withColumn("blocks", at(self.blocks, F.col("number")))
        slots = slots.select("shard", "number", F.floor(F.col("r") / F.col("blocks")).alias("epoch"), F.pmod("r", "blocks").alias("place"), "blocks")
        return slots.select("shard", "number", "epoch", permuted(F.col("place"), F.col("blocks"), F.col("number"), F.col("epoch")).alias("block"))

    def placed(self) -> DataFrame:
        """Each document with its first word's place in its source's layout. ``bucket`` and ``row`` tell repeated rows apart."""
        light = self.light.join(self.sources, self.light["source"].eqNullSafe(self.sources["source"])).drop(self.sources["source"])
        light = light.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(ORDER_SEED)), F.col("buckets")))
        sums = light.groupBy("number", "bucket").agg(F.sum("size").alias("bucket_size"))
        earlier = F.coalesce(F.sum("bucket_size").over(W.partitionBy("number").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        sums = sums.select("number", "bucket", earlier.alias("bucket_start"))
        within = W.partitionBy("number", "bucket").orderBy("doc_id", "size")
        placed = light.withColumn("row", F.row_number().over(within)).withColumn("upto", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)))
        placed = placed.join(sums, ["number", "bucket"])
        return placed.withColumn("start", F.col("bucket_start") + F.col("upto") - F.col("size")).drop("upto", "bucket_start", "buckets")

    def taken(self) -> DataFrame:
        """Each document's doc_id, size, source_size, target and taken (with the key, if there is one)."""
        # the optimizer takes the slots for as few as the counts that they are expanded from: they must not be broadcast
        times = self.drawn_slots().groupBy("number", "block").agg(F.count("*").alias("times")).hint("merge")
        first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
        parts = self.placed().withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
        part = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.greatest(F.col("start"), F.col("block") * BLOCK)
        parts = parts.join(times, ["number", "block"], "left")
        keys = ["number", "bucket", "row"]
        kept = [c for c in ("doc_id", "size", "source_size", "target", "key") if c in parts.columns]
        sums = parts.groupBy(*keys).agg(*[F.first(c).alias(c) for c in kept], F.sum(F.coalesce(part * F.col("times"), F.lit(0))).cast("long").alias("taken"))
        return sums.select(*kept, "taken")


def mix(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return Mix(docs, **columns).taken()


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: each row as often as the mix takes its words, rounded up or down by a hash so that
    sums keep to the targets; a row that is not taken goes, one without words stays once."""
    key = F.xxhash64(F.col(doc_id), F.col(source), F.col(text))
    taken = Mix(docs, doc_id, text, source, key=key).taken()
    ratios = taken.groupBy("key").agg(F.try_divide(F.sum("taken"), F.sum("size")).alias("_veil_ratio")).withColumnRenamed("key", "_veil_key")
    rows = docs.withColumn("_veil_key", key).join(ratios, "_veil_key")
    copies = F.coalesce(F.floor(F.col("_veil_ratio") + hash_unit(F.col("_veil_key"), seed=DRAW_SEED)), F.lit(1)).cast("int")
    rows = rows.withColumn("_veil_copy", F.explode(F.array_repeat(F.lit(0), F.least(copies, F.lit(MOST_REPEATS)))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
