"""Near-duplicate documents by DartMinHash.

A text is its multiset of five-word shingles (lower-cased letters and digits; characters of scripts without spaces are
words of their own). Every shingle throws darts: each unit cell (weight, rank) of its plane holds a Poisson(1) number of
darts, fixed by hashing, with a uniform rank in the cell and a coordinate. A text meets the darts of its shingles' weight
(their count) up to a rank at which about ``DARTS`` darts fall, and keeps the earliest of each of ``BANDS * ROWS``
coordinates; two texts agree in a coordinate with the probability of their weighted Jaccard likeness. A text that leaves
a coordinate empty throws again up to twice the rank. A text that repeats shingles has a second signature, with all weights 1,
whose agreement with another text's (its only one, if that repeats none) follows the likeness of the sets; its bands are joined like the others.

Bands of ``ROWS`` coordinates are joined. Within a bucket every text is paired with two of its members, the first in an
order of all texts and the last in one of ``HEAD_ORDERS`` other orders: pairs grow with the texts, not with the square of
a bucket, and texts of a large class share their few heads in all buckets. Buckets of up to ``PAIRED_WHOLE`` texts are
paired whole. A larger bucket whose members are not all of one class by now is paired with one more head, the member that
meets most such buckets (a text amid its copies shares more buckets than they do). The texts of buckets that are open even
then, as those that share a passage only are, are joined exactly, by prefixes: of two texts that are alike enough, the
first few shingles of one, in an order of all shingles that begins with the rare ones, hold one of the other's first few.
How many these are depends on both sizes, so that texts meet by shingle and class of size, and the places of a common
shingle bound what can follow. Texts of one class never meet: in each such group, only members outside the group's main
class are paired with members of other classes. So every pair of a bucket is compared, unless both are in one class
already. Candidate pairs whose signatures agree in fewer than ``LIKELY`` of the coordinates, as multisets and as sets, are
put aside (at a true 0.8 this has a chance of about 1e-8), all others are checked exactly on their whole shingle
multisets. A link holds at a likeness of ``LIKENESS`` or more, as sets or as multisets.

Equal texts are one node throughout. No text, signature or link comes to the driver.

Defined cases: null texts count as empty; texts without a word (letter or digit) are linked only with equal texts; texts
of fewer than five words are one shingle of all their words; repeated rows are in one class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.llm.common import bounded_batches, cut, cut_few, joined, kept_by_worker
from veilspan.llm.components import components

SHINGLE, LIKENESS, LIKELY = 5, 0.8, 0.6
BANDS, ROWS = 25, 5
HEAD_ORDERS, PAIRED_WHOLE = 5, 12
COORDINATES = BANDS * ROWS
#: Counters of shingles, which give their order (shingles that share one are ordered by hash), and the step between two classes
#: of size.
COUNTERS, SIZE_STEP = 1 << 20, 1.025
#: Texts to be compared are found by a broadcast list up to so many of them (about 40 bytes each), beyond it by a shuffle.
BROADCAST_TEXTS = 500_000
#: Expected darts of a text: coordinates * (ln(coordinates) + 6).
DARTS = int(COORDINATES * (np.log(COORDINATES) + 6))
#: Scripts that are written without spaces.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORDS = rf"[{UNSPACED}]|[[\p{{L}}\p{{N}}\p{{M}}]&&[^{UNSPACED}]]+"
#: Words that are worked on at once; a text counts as so many at least, as short texts throw as many darts as long ones.
CHUNK_WORDS, LEAST_WORDS = 150_000, 500
#: Poisson(1): chances of at most 0, 1, 2 .. darts in a cell, in 2^32nds.
POISSON = (np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)])) * 2**32).astype(np.uint64)
_U = np.uint64


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0)), lambda w: F.xxhash64(w))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix (three rounds of xor-shift and multiply), in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def shingles(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of these texts (words laid end to end), and each one's text number."""
    ends = np.cumsum(lengths)
    counts = np.where(lengths > 0, np.maximum(lengths - SHINGLE + 1, 1), 0)
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = np.repeat(ends - lengths - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    last = ends[owner]
    padded = np.concatenate([words.astype(np.uint64), np.zeros(SHINGLE, np.uint64)])
    value = np.zeros(len(first), np.uint64)
    for j in range(SHINGLE):
        value = value * _U(0x9E3779B97F4A7C15) + np.where(first + j < last, padded[np.minimum(first + j, len(words))], _U(j + 1))
        value ^= value >> _U(29)
    return _mixed(value), owner


def weighed(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    return values[starts], owner[starts], np.diff(np.append(starts, len(values)))


def _throw(values: np.ndarray, owner: np.ndarray, counts: np.ndarray, top: np.ndarray, signature: np.ndarray) -> None:
    """Lowers the texts' coordinates to the earliest dart up to each text's rank ``top``. A rank has 20 whole bits."""
    ranks = np.ceil(top).astype(np.int64)[owner]
    cells = counts * ranks
    of = np.repeat(np.arange(len(values)), cells)
    number = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    weight, rank = number // ranks[of], (number % ranks[of]).astype(np.uint64)
    cell = _mixed(values[of] + weight.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + rank * _U(0xA0761D6478BD642F))
    darts = np.searchsorted(POISSON, cell >> _U(32), side="right")
    dart = np.repeat(np.arange(len(cell)), darts)
    nth = (np.arange(len(dart)) - np.repeat(np.cumsum(darts) - darts, darts)).astype(np.uint64)
    thrown = _mixed(cell[dart] + (nth + _U(1)) * _U(0xE7037ED1A0B428DB))
    position = rank[dart] << _U(44) | thrown >> _U(20)
    text = owner[of[dart]]
    kept = position < (top[text] * 2.0**44).astype(np.uint64)
    np.minimum.at(signature.reshape(-1), text[kept] * COORDINATES + ((thrown[kept] & _U(0xFFFFF)) % _U(COORDINATES)).astype(np.int64), position[kept])


EMPTY = _U(2**64 - 1)


def signatures(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A row of coordinates for each text; a text without words keeps ``EMPTY`` ones."""
    return _signatures(*weighed(*shingles(words, lengths)), len(lengths))


def _signatures(values: np.ndarray, owner: np.ndarray, counts: np.ndarray, texts: int) -> np.ndarray:
    signature = np.full((texts, COORDINATES), EMPTY)
    total = np.bincount(owner, counts, texts)
    top = DARTS / np.maximum(total, 1)
    open_ = total > 0
    while open_.any():
        rows = open_[owner]
        _throw(values[rows], owner[rows], counts[rows], top, signature)
        open_ = open_ & (signature == EMPTY).any(1)
        top = np.where(open_, top * 2, top)
    return signature


def bands_of(signature: np.ndarray) -> np.ndarray:
    grouped = signature.reshape(-1, BANDS, ROWS)
    value = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(signature), 0)
    for j in range(ROWS):
        value = _mixed(value * _U(0x9E3779B97F4A7C15) + grouped[:, :, j])
    return value.view(np.int64)


def _chunks(lengths: np.ndarray) -> Iterator[slice]:
    begin, words = 0, 0
    for i, n in enumerate(lengths):
        n = max(n, LEAST_WORDS)
        if words and words + n > CHUNK_WORDS:
            yield slice(begin, i)
            begin, words = i, 0
        words += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def _by_chunk(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """Each batch with its last column, lists of word hashes, replaced by what ``make`` returns for them."""
    kept_by_worker()
    for batch in batches:
        lists = batch.columns[-1]
        offsets = lists.offsets.to_numpy()
        words, lengths = lists.values.to_numpy(zero_copy_only=False), np.diff(offsets)
        for part in _chunks(lengths):
            made = make(words[offsets[part.start] : offsets[part.stop]], lengths[part])
            columns = [c.slice(part.start, part.stop - part.start) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, *made.values()], names=[*batch.schema.names[:-1], *made])


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64()))


def _signed(words: np.ndarray, lengths: np.ndarray) -> dict[str, pa.Array]:
    values, owner, counts = weighed(*shingles(words, lengths))
    signature = _signatures(values, owner, counts, len(lengths))
    bands, some = bands_of(signature), lengths > 0
    repeats = np.zeros(len(lengths), bool)
    repeats[owner[counts > 1]] = True
    of_sets, rows = np.cumsum(repeats) - 1, repeats[owner]
    as_set = _signatures(values[rows], of_sets[owner[rows]], np.ones(rows.sum(), np.int64), repeats.sum())
    set_bands = bands_of(as_set)
    lists = [np.unique(np.concatenate([b, set_bands[i]])) if r else b if s else b[:0] for b, s, r, i in zip(bands, some, repeats, of_sets, strict=True)]
    # a byte of each coordinate
    sketch, set_sketch = ((x & _U(0xFF)).astype(np.uint8) for x in (signature, as_set))
    return {
        "bands": _lists(lists),
        "sketch": pa.array([r.tobytes() for r in sketch], pa.binary()),
        "set_sketch": pa.array([set_sketch[i].tobytes() if r else None for r, i in zip(repeats, of_sets, strict=True)], pa.binary()),
    }


def _elements(words: np.ndarray, lengths: np.ndarray) -> dict[str, pa.Array]:
    """A text's distinct shingles, and beside them one element for each further occurrence: as sets, both together have the
    multisets' likeness."""
    values, owner, counts = weighed(*shingles(words, lengths))
    again = np.repeat(np.arange(len(values)), counts - 1)
    nth = np.arange(len(again)) - np.repeat(np.cumsum(counts - 1) - (counts - 1), counts - 1)
    more = _mixed(values[again] + (nth.astype(np.uint64) + _U(1)) * _U(0x8EBC6AF09C88C6E3)).view(np.int64)
    once, texts = values.view(np.int64), np.arange(1, len(lengths))
    return {"once": _lists(np.split(once, np.searchsorted(owner, texts))), "more": _lists(np.split(more, np.searchsorted(owner[again], texts)))}


LONGS = T.ArrayType(T.LongType())


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, bands, sketch (a byte of each coordinate) and set_sketch (null where no shingle is repeated) of every row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key"), word_hashes(F.col(text)).alias("words"))
    schema = T.StructType([rows.schema["doc_id"], rows.schema["text_key"], T.StructField("bands", LONGS), T.StructField("sketch", T.BinaryType()), T.StructField("set_sketch", T.BinaryType())])
    return rows.mapInArrow(lambda batches: _by_chunk(batches, _signed), schema)


@F.pandas_udf(T.DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    left, right = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((left == right).mean(1))


def size_class(size: int) -> int:
    return int(np.log(size) / np.log(SIZE_STEP))


def prefixes(elements: DataFrame, likeness: float) -> DataFrame:
    """key, node, place, size and probe of the first elements of these texts (node, once, more), as sets and as multisets.

    The smaller of two alike texts offers its first ones under its class of size; the larger asks for its own first ones
    under each class that the smaller can have. Rare elements come first, by bounded counters over all these texts.
    """
    counted = elements.select(F.explode(F.concat("once", "more")).alias("e")).groupBy(F.pmod("e", F.lit(COUNTERS)).alias("at")).count()
    counts = np.zeros(COUNTERS, np.int64)
    for at, n in counted.collect():  # COUNTERS rows at most
        counts[at] = n
    as_multisets = not elements.where(F.size("more") > 0).isEmpty()
    share = likeness / (1 + likeness)

    def needed(total: int) -> int:
        """Common elements that two texts of so many together must have."""
        return int(np.ceil(share * total - 1e-9))

    def of_text(tokens: np.ndarray, kind: int) -> list[tuple[np.ndarray, int, bool]]:
        n = len(tokens)
        tokens = tokens[np.lexsort((tokens, counts[tokens % COUNTERS]))].view(np.uint64)
        key = lambda first, of_size: _mixed(tokens[:first] * _U(0x9E3779B97F4A7C15) + _U(2 * of_size + kind)).view(np.int64)
        out = [(key(n - needed(2 * n) + 1, size_class(n)), n, False)]
        least = max(1, int(np.ceil(likeness * n - 1e-9)))
        for of_size in range(size_class(least), size_class(n) + 1):
            smallest = least
            while size_class(smallest) < of_size:
                smallest += 1
            if smallest <= n and size_class(smallest) == of_size:
                out.append((key(n - needed(n + smallest) + 1, of_size), n, True))
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker()
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            for at, node in enumerate(nodes):
                once, more = (batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in ("once", "more"))
                parts = of_text(once, 0) if len(once) else []
                if as_multisets and len(once):
                    parts += of_text(np.concatenate([once, more]), 1)
                if parts:
                    keys = np.concatenate([k for k, _, _ in parts])
                    lengths = [len(k) for k, _, _ in parts]
                    columns = [keys, np.full(len(keys), node), np.concatenate([np.arange(n) for n in lengths]).astype(np.int32), np.repeat([n for _, n, _ in parts], lengths).astype(np.int32), np.repeat([p for _, _, p in parts], lengths)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "place", "size", "probe"])

    return elements.select("node", "once", "more").mapInArrow(rows, "key long, node long, place int, size int, probe boolean")


def prefix_pairs(elements: DataFrame, labels: DataFrame, likeness: float) -> DataFrame:
    """Pairs a < b of texts of different classes that may be as alike, by their prefixes."""
    posted = cut_few(prefixes(elements, likeness).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    classes = posted.groupBy("key", "label").agg(F.count("*").alias("n"), F.max("probe").alias("asks"), F.min("probe").alias("only_asks"))
    keys = classes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("classes"), F.max("asks").alias("asks"), F.min("only_asks").alias("only_asks"), F.sum("n").alias("rows"))
    keys = cut_few(keys.where("classes > 1 and asks and not only_asks").select("key", F.col("main.label").alias("main"), "rows"))
    posted = cut_few(joined(posted, keys, "key", rows="rows"))
    named = lambda rows, end: rows.select("key", *[F.col(c).alias(f"{c}_{end}") for c in ("node", "place", "size", "label")])
    asking, offering, outside = posted.where("probe"), posted.where("not probe"), F.col("label") != F.col("main")
    met_ = named(asking.where(outside), "x").join(named(offering, "y"), "key").unionByName(named(asking.where(~outside), "x").join(named(offering.where(outside), "y"), "key"))
    met_ = met_.where("label_x <> label_y")
    needed = F.ceil(likeness / (1 + likeness) * (F.col("size_x") + F.col("size_y")) - 1e-9)
    possible = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y"))
    fit = (F.col("size_y") <= F.col("size_x")) & (F.col("size_y") >= likeness * F.col("size_x") - 1e-9) & (possible >= needed)
    return met_.where(fit).select(*_ordered("node_x", "node_y")).distinct()


def met(banded: DataFrame) -> DataFrame:
    """node, band and members of the bands (node, band) that several texts have. Bands are counted before anything else of
    them crosses the network: nearly all belong to one text."""
    shared = cut_few(banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"))
    return cut_few(joined(banded, shared.withColumn("rows", F.col("members")), "band", rows="rows"))


def _ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def agreeing(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs whose signatures, as multisets or as sets, agree in ``LIKELY`` of the coordinates or more."""
    sketches, n, given = texts.select("node", "sketch", "set_sketch"), pairs.count(), pairs
    for end in ("a", "b"):
        pairs = joined(pairs, sketches.withColumnsRenamed({"node": end, "sketch": f"sketch_{end}", "set_sketch": f"set_{end}"}), end, total=n, counted=given)
    sets = [F.coalesce(f"set_{end}", f"sketch_{end}") for end in ("a", "b")]
    return pairs.where(F.greatest(_agreement("sketch_a", "sketch_b"), _agreement(*sets)) >= LIKELY).select("a", "b")


def candidates(members: DataFrame) -> DataFrame:
    """Pairs a < b of every text with its buckets' heads, and of all texts in small buckets. ``members``: as ``met`` gives them."""
    # one order of all nodes and a few others: the members of a large class meet the same few heads in all its buckets
    turned = F.xxhash64("node", F.pmod("band", F.lit(HEAD_ORDERS)))
    heads = members.groupBy("band").agg(F.min_by("node", F.xxhash64("node")).alias("low"), F.max_by("node", turned).alias("last"), F.min_by("node", turned).alias("first"), F.count("*").alias("rows"))
    # the second head is another text than the first: where one is last in its turn's order, the first in it
    heads = cut_few(heads.select("band", "low", F.when(F.col("last") != F.col("low"), F.col("last")).otherwise(F.col("first")).alias("high"), "rows"))
    pairs = joined(members.select("node", "band"), heads, "band", rows="rows").select("node", F.explode(F.array("low", "high")).alias("head")).where("node <> head").select(*_ordered("node", "head"))
    # of up to three members every pair has a head; somewhat larger buckets are paired whole
    lists = members.where(F.col("members").between(4, PAIRED_WHOLE)).groupBy("band").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    others = F.transform("nodes", lambda x, i: F.transform(F.slice("nodes", i + 2, F.size("nodes")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    return pairs.union(lists.select(F.inline(F.flatten(others)))).distinct()


def opened(members: DataFrame, labels: DataFrame) -> DataFrame:
    """node, band, label and members of the members (node, band) of buckets that hold several classes."""
    members = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = members.groupBy("band").agg(F.count("*").alias("members"), F.min("label").alias("least"), F.max("label").alias("most"))
    counts = cut_few(counts.where("least <> most").select("band", "members", F.col("members").alias("rows")))
    return cut_few(joined(members.select("node", "band", "label"), counts, "band", rows="rows"))


def central_pairs(open_: DataFrame) -> DataFrame:
    """Pairs a < b of the member that is in most of these buckets (``opened``) with all others of its bucket's other classes."""
    most = open_.groupBy("node").agg(F.count("*").alias("met"))
    central = open_.join(most, "node").groupBy("band").agg(F.max_by(F.struct("node", "label"), F.struct("met", F.xxhash64("node", "band"))).alias("head"), F.count("*").alias("rows"))
    central = cut_few(central.select("band", F.col("head.node").alias("head"), F.col("head.label").alias("head_label"), "rows"))
    return joined(open_.select("node", "band", "label"), central, "band", rows="rows").where("label <> head_label").select(*_ordered("node", "head")).distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node and label after further links between nodes, of which some have no label yet."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    labels = cut_few(labels.select("node", "label").union(ends.select("node", F.col("node").alias("label"))))
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")), end)
    joined = components(links.select("of_a", "of_b"), "of_a", "of_b").select(F.col("node").alias("label"), F.col("label").alias("to"))
    return cut_few(labels.join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def likeness_of(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """The pairs with their exact likeness: the larger of that of the sets and that of the multisets."""
    n, given = pairs.count(), pairs
    for end in ("a", "b"):
        pairs = joined(pairs, elements.select(F.col("node").alias(end), F.struct("once", "more").alias(f"of_{end}")), end, total=n, counted=given)
    size = lambda end, kind: F.size(f"of_{end}.{kind}")
    common = {kind: F.size(F.array_intersect(f"of_a.{kind}", f"of_b.{kind}")) for kind in ("once", "more")}
    pairs = pairs.withColumns({f"common_{k}": c for k, c in common.items()} | {"once_a": size("a", "once"), "once_b": size("b", "once"), "all": size("a", "once") + size("b", "once") + size("a", "more") + size("b", "more")})
    sets = F.col("common_once") / (F.col("once_a") + F.col("once_b") - F.col("common_once"))
    shared = F.col("common_once") + F.col("common_more")
    return pairs.select("a", "b", F.greatest(sets, shared / (F.col("all") - shared)).alias("likeness"))


class NearDuplicates:
    """Classes of a table. ``rows``: doc_id and text_key of every row; ``texts``: node, text_key, first_id (least doc_id)
    and copies of every distinct text; ``links``: verified pairs of nodes; ``labels``: node and label of linked nodes."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", likeness: float = LIKENESS):
        rows = cut(signed(docs, doc_id, text))
        self.rows = rows.select("doc_id", "text_key")
        texts = rows.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("set_sketch").alias("set_sketch"))
        texts = cut_few(texts.withColumn("node", F.monotonically_increasing_id()))
        self.texts = texts.select("node", "text_key", "first_id", "copies")
        self._texts, self._docs, self._likeness = texts, docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), likeness
        self._tried, self.links = None, docs.sparkSession.createDataFrame([], "a long, b long")
        self.labels = docs.sparkSession.createDataFrame([], "node long, label long")
        members = met(texts.select("node", F.explode("bands").alias("band")))
        self._compare(candidates(members))
        large = cut_few(members.where(F.col("members") > PAIRED_WHOLE).select("node", "band"))
        open_ = opened(large, self.labels)
        if not open_.isEmpty():
            self._compare(central_pairs(open_))
            nodes = cut_few(opened(large, self.labels).select("node").distinct())
            if not nodes.isEmpty():
                self._compare(prefix_pairs(self._elements(nodes), self.labels, likeness))

    def _compare(self, pairs: DataFrame) -> None:
        """Adds the links among these pairs of texts, without those of one class and those that were compared before."""
        pairs = given = cut_few(pairs)
        if self._tried is not None:  # nothing was compared, so nothing is in a class, before
            n = pairs.count()
            for end in ("a", "b"):
                labels = self.labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}"))
                pairs = joined(pairs, labels, end, how="left", total=n, counted=given).withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
            pairs = cut_few(pairs.where("of_a <> of_b").select("a", "b").join(self._tried, ["a", "b"], "left_anti"))
        pairs = cut_few(agreeing(pairs, self._texts))
        if pairs.isEmpty():
            return
        links = self._verified(pairs)
        self._tried = pairs if self._tried is None else self._tried.union(pairs)
        if not links.isEmpty():
            self.links = self.links.union(links.select("a", "b"))
            self.labels = merged(self.labels, links)

    def _elements(self, nodes: DataFrame) -> DataFrame:
        """node, once and more of these texts. Texts stay where they are as far as the list of those that are needed is small
        enough to go to them."""
        involved = cut_few(nodes.join(self.texts, "node").select("node", "first_id", F.col("text_key").alias("key")))
        if involved.count() <= BROADCAST_TEXTS:
            involved = F.broadcast(involved)
        words = self._docs.join(involved, F.col("doc_id").eqNullSafe(F.col("first_id"))).where(text_key(F.col("text")) == F.col("key")).select("node", word_hashes(F.col("text")).alias("words"))
        schema = T.StructType([words.schema["node"], T.StructField("once", LONGS), T.StructField("more", LONGS)])
        return cut_few(words.mapInArrow(lambda batches: _by_chunk(batches, _elements), schema).dropDuplicates(["node"]))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose exact likeness is as high."""
        elements = self._elements(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        return cut_few(likeness_of(pairs, elements).where(F.col("likeness") >= self._likeness))

    def text_classes(self) -> DataFrame:
        """Distinct texts with class_id (the least doc_id of their class), class_size (rows) and first_id."""
        texts = cut_few(self.texts.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
        head = F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("head")
        classes = cut_few(texts.groupBy("label").agg(head, F.sum("copies").alias("class_size"), F.count("*").alias("texts")))
        return joined(texts, classes, "label", rows="texts").select("text_key", "first_id", "copies", F.col("head.first_id").alias("class_id"), (F.col("head.node") == F.col("node")).alias("is_head"), "class_size")

    def classes(self) -> DataFrame:
        """Every row's doc_id, class_id, class_size."""
        return joined(self.rows, cut_few(self.text_classes()), "text_key", rows="copies").select("doc_id", "class_id", "class_size")


def near_duplicates(docs: DataFrame, **columns) -> DataFrame:
    return NearDuplicates(docs, **columns).classes()


def _row_key(of_text: Column, doc_id: Column) -> Column:
    return F.unhex(F.md5(F.concat(of_text, F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("null")).cast("binary"))))


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id. A row that is repeated whole stays once. Rows cross the
    network once: what is kept and what is repeated are told by one key of id and text."""
    heads = NearDuplicates(docs, doc_id, text).text_classes().where("is_head").select(_row_key(F.col("text_key"), F.col("first_id")).alias("_veil_row"))
    kept = docs.withColumn("_veil_row", _row_key(text_key(F.col(text)), F.col(doc_id))).join(heads, "_veil_row", "left_semi")
    return kept.dropDuplicates(["_veil_row"]).select(*[F.col(f"`{c}`") for c in docs.columns])
