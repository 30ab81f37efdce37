"""Sharding by balanced label propagation, with DataFrame functions only.

Documents start in the shard that a hash gives them. Linked documents share a hub: equal texts have the text's hash as
hub, documents linked in any other way the cluster that label propagation finds for them (``clusters``). In each round a
hub's members are counted by shard, and members move towards the shard that holds most of their hub's, as far as the
shards' quotas allow: the driver solves, from the counts of wished moves between shards (at most shards x shards
numbers), what share of its wished arrivals each shard can take. Shards that are full are no goals; a hub larger than a
shard has as many goals as it needs shards. When nothing moves any more, or ``PATIENCE`` rounds in a row brought no one
per cent fewer members away from their goals, hubs that are still divided between full shards go whole to shards that
have room, by the same quotas, until that ends in the same way. At last counts are made even: documents without links leave over-full
shards first, then whole hubs as far as possible, and take the free slots of others.

Only ids and hub numbers are shuffled, never texts. A hub, or a document with links, of very many rows is dealt into pieces
in every join (``joined``). Slots are numbered in hashed buckets of about ``BUCKET_ROWS`` rows.

Defined cases: null texts count as empty and are linked with empty ones; repeated rows each get a slot; with fewer rows
than shards some shards stay empty; links to unknown nodes and from a node to itself count for nothing; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.llm.common import constants, cut, hash_unit, interval_of, joined

SHARDS, SLACK, BUCKET_ROWS = 24, 0.04, 50_000
#: From this share of its quota on a shard counts as full.
FULL = 0.98
#: Rounds without one per cent of progress after which propagation ends.
PATIENCE = 3
#: A cluster of linked documents holds at most this share of a shard's documents.
CLUSTER_SHARE = 0.25
OVERHEAD = 8


def accepted_shares(moves: dict[tuple[int, int], int], loads: list[int], capacity: float) -> list[float]:
    """For each shard the share of its wished arrivals that leaves it at or under capacity, given what leaves it."""
    shards = range(len(loads))
    arriving = [sum(n for (_, b), n in moves.items() if b == s) for s in shards]
    share = [1.0] * len(loads)
    for _ in range(60):
        for s in shards:
            if arriving[s]:
                leaving = sum(n * share[b] for (a, b), n in moves.items() if a == s)
                share[s] = min(1.0, max(0.0, (capacity - loads[s] + leaving) / arriving[s]))
    return share


def _counted(df: DataFrame, shards: int) -> list[int]:
    got = dict(df.groupBy("shard").agg(F.count("*")).collect())  # a row per shard
    return [got.get(s, 0) for s in range(shards)]


class _Progress:
    """Whether what is left to do still shrinks."""

    def __init__(self):
        self.best, self.idle = None, 0

    def stalled(self, left: int) -> bool:
        if self.best is None or left < 0.99 * self.best:
            self.best, self.idle = left, 0
        else:
            self.idle += 1
        return self.idle >= PATIENCE


def propagate(nodes: DataFrame, hubs: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """``nodes`` (node) with a shard; ``hubs`` (node, hub) names who belongs together, with one hub at most for a node.
    Columns: node, hub (null where nothing shares it), shard."""
    sizes = cut(hubs.groupBy("hub").agg(F.count("*").alias("members")).where("members > 1"))
    start = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(shards)).cast("int")
    linked = joined(hubs, sizes.withColumn("rows", F.col("members")), "hub", rows="rows")
    linked = cut(linked.select("node", "hub", "members", start.alias("shard")))
    single = nodes.join(linked.select("node"), "node", "left_anti").select("node", F.lit(None).cast(hubs.schema["hub"].dataType).alias("hub"), start.alias("shard"))
    total = nodes.count()
    capacity = total / shards * (1 + slack)
    fixed = _counted(single, shards)
    progress, turn, whole = _Progress(), 0, False
    while True:
        own = _counted(linked, shards)
        # what has no links can make room later, as far as the shard has any of it; nearly full shards are no goals of large hubs
        room = constants([int(load < capacity) + int(load < FULL * capacity) for load in own])
        counts = linked.groupBy("hub", "shard").agg(F.count("*").alias("n"), F.first("members").alias("members"))
        ranked = F.struct((-F.col("n")).alias("less"), F.xxhash64("hub", "shard").alias("tie"), "shard", F.get(room, F.col("shard")).alias("open"))
        held = F.map_from_entries(F.collect_list(F.struct("shard", "n")))  # at most one entry a shard
        goals = counts.groupBy("hub").agg(F.sort_array(F.collect_list(ranked)).alias("ranked"), held.alias("held"), F.first("members").alias("members"), F.count("*").alias("in_shards"))
        shards_of = lambda array, open_: F.transform(F.filter(array, lambda o: o["open"] >= open_), lambda o: o["shard"])
        needed = F.ceil(F.col("members") / capacity).cast("int")
        goals = goals.where("in_shards > 1").select("*", (needed > 1).alias("large"), F.slice("ranked", 1, F.greatest(F.lit(1), needed)).alias("own"))
        # a small hub's goal is its fullest open shard. A large one's members stay in its fullest shards, as many as it needs; its
        # goals are those of them that are open, or else the next open one
        next_, first = F.slice(shards_of("ranked", 2), 1, 1), F.slice(shards_of("ranked", 1), 1, 1)
        if whole:
            # what is still divided goes whole to any shard, in proportion to the room there
            free = [max(0, int(capacity - load)) for load in own]
            place = F.pmod(F.xxhash64("hub", F.lit(turn), F.lit(29)), F.lit(max(1, sum(free))))
            first = F.array(interval_of([sum(free[: i + 1]) for i in range(shards)], place))
            goals = goals.where(~F.col("large") & F.lit(sum(free) > 0))
        goals = goals.withColumn("goals", F.when(~F.col("large"), first).when(F.size(shards_of("own", 2)) > 0, shards_of("own", 2)).otherwise(next_))
        stay = F.when(F.col("large"), F.array_union(shards_of("own", 0), "goals")).otherwise(F.col("goals"))
        goals = cut(goals.where(F.size("goals") > 0).select("hub", "held", "members", "goals", "large", stay.alias("stay")))
        wishes = joined(linked.select("node", "hub", "shard"), goals.withColumn("rows", F.col("members")), "hub", rows="rows")
        wishes = wishes.withColumn("goal", F.get("goals", F.pmod(F.xxhash64("node", F.lit(turn)), F.size("goals")).cast("int")))
        # a hub has the same goals throughout a round, so moving at no gain can't go to and fro within it
        gains = F.coalesce(F.element_at("held", F.col("goal")), F.lit(0)) >= F.element_at("held", F.col("shard"))
        wishes = cut(wishes.where(~F.array_contains("stay", F.col("shard")) & (F.col("large") | F.lit(whole) | gains)).select("node", "hub", "members", "shard", "goal"))
        moves = {(r["shard"], r["goal"]): r["n"] for r in wishes.groupBy("shard", "goal").agg(F.count("*").alias("n")).collect()}
        if not moves or progress.stalled(sum(moves.values())):
            if whole:
                break
            progress, whole = _Progress(), True
            continue
        share = accepted_shares(moves, own, capacity)
        coin = F.when(F.col("members") <= max(2.0, capacity / 50), hash_unit(F.col("hub"), seed=turn)).otherwise(hash_unit(F.col("node"), seed=turn))
        moved = wishes.where(coin < F.get(constants(share, "double"), F.col("goal"))).select("node", "goal")
        linked = cut(linked.join(moved, "node", "left").select("node", "hub", "members", F.coalesce("goal", "shard").cast("int").alias("shard")))
        turn += 1
    return linked.select("node", "hub", "shard").unionByName(single)


def clusters(links: DataFrame, most: int) -> DataFrame:
    """node and hub of every linked node: label propagation with at most about ``most`` nodes a label.

    ``links``: a, b, weight, each pair once. All nodes start with their own label. In each round a label either gives or takes
    (by a hash of it and of the round, so that two never swap), and a node of a giving label moves to the taking label to
    which it has the greatest weight of links, if that is more than to its own (or as much, where the taking label is the
    lesser), as far as that label's quota of new nodes allows. Rounds end when no node of any label has such a wish, or
    when their number does not shrink any more.
    """
    both = cut(links.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").union(links.select("b", "a", "weight")))
    labels = cut(both.select("node").distinct().withColumn("label", F.col("node")))
    progress, turn = _Progress(), 0
    while True:
        near = joined(both, labels.select(F.col("node").alias("other"), "label"), "other")
        near = near.groupBy("node", "label").agg(F.sum("weight").alias("weight")).withColumnRenamed("label", "near")
        sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
        near = cut(near.join(labels, "node"))
        own = near.where("near = label").select("node", F.col("weight").alias("own"))
        best = near.where("near <> label").join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        better = (F.col("weight") > F.col("own")) | ((F.col("weight") == F.col("own")) & (F.col("near") < F.col("label")))
        open_ = sizes.where(F.col("size") < most).select(F.col("label").alias("near"), (F.lit(most) - F.col("size")).alias("room"))
        best = cut(joined(cut(best.where(better).select("node", "label", "near", "weight")), open_, "near"))
        left = best.select("node").distinct().count()
        # a round lets about a quarter of all wishes come true, so that several rounds make up one step of progress
        if not left or turn % 8 == 7 and progress.stalled(left):
            return labels.withColumnRenamed("label", "hub")
        taking = lambda c: F.pmod(F.xxhash64(c, F.lit(turn), F.lit(23)), F.lit(2)) == 1
        wish = best.where(taking("near") & ~taking("label")).groupBy("node").agg(F.max(F.struct("weight", F.xxhash64("near", F.lit(turn)), "near", "room")).alias("to"))
        wish = cut(wish.select("node", "to.near", "to.room"))
        wished = cut(wish.groupBy("near").agg(F.count("*").alias("wished")))
        wish = joined(wish, wished.withColumn("rows", F.col("wished")), "near", rows="rows")
        moved = wish.where(hash_unit(F.col("node"), seed=turn) * F.col("wished") < F.col("room")).select("node", "near")
        labels = cut(labels.join(moved, "node", "left").select("node", F.coalesce("near", "label").alias("label")))
        turn += 1


def even_slots(placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Counts made equal up to one, with a slot in the shard from 0 for each node. Columns: node, shard, slot."""
    loads = _counted(placed, shards)
    total = sum(loads)
    larger = set(sorted(range(shards), key=lambda s: (-loads[s], s))[: total % shards])
    goal = [total // shards + (s in larger) for s in range(shards)]
    over, short = [max(0, a - b) for a, b in zip(loads, goal, strict=True)], [max(0, b - a) for a, b in zip(loads, goal, strict=True)]
    over_from, short_ends = [sum(over[:i]) for i in range(shards)], [sum(short[: i + 1]) for i in range(shards)]
    buckets = max(1, -(-total // shards // BUCKET_ROWS))
    # linked nodes come first in a shard's numbering, hub by hub, so that those without links are over, and then whole hubs.
    # A hub of many nodes spreads over buckets by its nodes' hash
    spread = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(buckets))
    many = F.col("in_shard") > BUCKET_ROWS // 10
    hub_sizes = placed.where("hub is not null").groupBy("hub", "shard").agg(F.count("*").alias("in_shard")).where(F.col("in_shard") > BUCKET_ROWS // 10)
    rows = placed.join(F.broadcast(hub_sizes), ["hub", "shard"], "left")  # at most total / (BUCKET_ROWS / 10) rows
    bucket = F.when(F.col("hub").isNull(), buckets + spread).when(many, spread).otherwise(F.pmod(F.xxhash64("hub", F.lit(3)), F.lit(buckets)))
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("number", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("hub", "node")))
    rows = rows.join(sums.select("shard", "bucket", before.alias("before")), ["shard", "bucket"])
    rows = rows.select("node", "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot"))

    def at(values: list[int], i: Column) -> Column:
        return F.get(constants(values), i)

    extra = F.when(F.col("slot") >= at(goal, F.col("shard")), at(over_from, F.col("shard")) + F.col("slot") - at(goal, F.col("shard")))
    rows = rows.withColumn("extra", extra).withColumn("to", F.when(F.col("extra").isNotNull(), interval_of(short_ends, F.col("extra"))))
    slot = at(loads, F.col("to")) + F.col("extra") - (at(short_ends, F.col("to")) - at(short, F.col("to")))
    return rows.select("node", F.coalesce("to", "shard").cast("int").alias("shard"), F.coalesce(slot, F.col("slot")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document; equal texts are the links."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("node"), F.col(doc_id).alias("doc_id"), F.octet_length(whole).cast("long").alias("bytes"),
        F.crc32(whole).cast("long").alias("text_crc32"), F.xxhash64(whole).alias("hub"),
    )
    rows = cut(rows)  # the row numbers stay what they are
    placed = cut(propagate(rows.select("node"), rows.select("node", "hub"), shards))
    return rows.join(even_slots(placed, shards), "node").select(
        "doc_id", (F.col("bytes") + OVERHEAD).alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shard_linked(nodes: DataFrame, links: DataFrame, node: str = "doc_id", source: str = "src", target: str = "dst", weight: str | None = None, shards: int = SHARDS) -> DataFrame:
    """Distinct nodes of ``nodes`` with shard and slot, for any table of links (repeated links, or their ``weight``, add up):
    clusters of linked nodes are kept together."""
    ids = cut(nodes.select(F.col(node).alias("node")).where("node is not null").distinct())
    ends = links.where(F.col(source) != F.col(target)).select(F.least(source, target).alias("a"), F.greatest(source, target).alias("b"), (F.col(weight) if weight else F.lit(1)).alias("weight"))
    ends = ends.groupBy("a", "b").agg(F.sum("weight").alias("weight")).where("weight > 0")
    for end in ("a", "b"):
        ends = joined(cut(ends), ids.withColumnRenamed("node", end), end)
    most = max(2, int(ids.count() / shards * CLUSTER_SHARE))
    found = clusters(ends, most)
    return even_slots(cut(propagate(ids, found, shards)), shards).withColumnRenamed("node", node)
