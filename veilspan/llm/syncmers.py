"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is a row of characters (code points) with ``K - 1`` sentinel characters on both sides, so that short texts have
k-mers too. ``K`` characters in a row are a k-mer, its inner rows of ``S`` characters are s-mers. A k-mer is chosen if the
least hash of its s-mers is that of the first or of the last one. Whether it is chosen depends on its own characters
alone, not on where it stands or what is around it, so an edit changes anchors only where it touches them.

An anchor is the position and the hash (32 bits) of a chosen k-mer. A fingerprint as text is the ``SKETCH`` least distinct
anchor hashes of the whole text. The likeness of two texts is the Jaccard likeness of all their anchor hashes, not of the
sketches. As anchors are context-free, those of an edited text are the original's anchors at their places in the part
that stays, and new ones only from where the edit begins.

Defined cases: null texts count as empty; an empty text has no anchor and an empty fingerprint; two texts without anchors
have likeness 1, one without and one with anchors 0; equal texts have equal fingerprints; rows that share an id follow
each other by their values' hash and meet in one range, as do all rows with a null id, which come first.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.llm.common import cut, interval_of, joined, let, partitions

K, S, SKETCH = 20, 12, 128
#: Sentinel characters before and behind a text.
BEFORE, BEHIND = "\x02", "\x03"
#: Every s-mer, one at each code point: what the group holds is looked at ahead of the one that is consumed.
SMERS = rf"(?s)(?=(.{{{S}}}))."
#: An anchor is packed in 64 bits: its hash above, its position (from -(K - 1), moved to be positive) below.
PLACE = 1 << 32
#: Texts of about so many bytes are put in order in one task.
RANGE_BYTES = 128 << 20


def padded(text: Column, before: bool = True, behind: bool = True) -> Column:
    """The text between its sentinels; empty for an empty text."""
    sides = [F.lit(c * (K - 1) if there else "") for c, there in ((BEFORE, before), (BEHIND, behind))]
    return F.when(text != "", F.concat(sides[0], text, sides[1])).otherwise(F.lit(""))


def _chosen(characters: Column, first_place: Column) -> Column:
    """Packed closed syncmers of these characters in order; the first k-mer stands at ``first_place``."""
    inner = K - S

    def of_smers(s: Column) -> Column:
        def kmer(first: Column, i: Column) -> Column:
            others = [F.get(s, i + j) for j in range(1, inner + 1)]
            least = F.least(first, *others)
            # the first and the last s-mer cover all characters of the k-mer
            packed = F.shiftleft(F.shiftrightunsigned(F.xxhash64(first, others[-1]), 32), 32) + first_place + i
            return F.when((first == least) | (others[-1] == least), packed)

        return F.transform(F.slice(s, 1, F.greatest(F.size(s) - inner, F.lit(0))), kmer)

    smers = F.transform(F.regexp_extract_all(characters, F.lit(SMERS), F.lit(1)), lambda u: F.xxhash64(u))
    return F.array_compact(let(smers, of_smers))


def packed_anchors(text: Column) -> Column:
    return _chosen(padded(text), F.lit(0).cast("long"))


def hashes(packed: Column) -> Column:
    """The distinct hashes of packed anchors."""
    return F.array_distinct(F.transform(packed, lambda a: F.shiftrightunsigned(a, 32)))


def anchors(text: Column) -> Column:
    """All closed syncmers of the text: array of (position of its first character, hash), for positional matching."""
    unpacked = lambda a: F.struct((a.bitwiseAND(F.lit(PLACE - 1)) - (K - 1)).cast("int").alias("position"), F.shiftrightunsigned(a, 32).alias("hash"))
    return F.transform(packed_anchors(text), unpacked)


def edited_anchors(text: Column, packed: Column, kept: Column, edit: Column) -> Column:
    """Packed anchors of the text's first ``kept`` characters with ``edit`` behind them: the text's own anchors in what stays
    (``packed``), and those of the k-mers that reach into the edit."""
    # of the part that stays, the last K - 1 characters are in k-mers with the edit's first
    inside = F.filter(packed, lambda a: a.bitwiseAND(F.lit(PLACE - 1)) <= kept - 1)
    seam = F.concat(F.substring(text, (kept - (K - 2)).cast("int"), F.lit(K - 1)), edit)
    short = _chosen(padded(F.concat(F.substring(text, F.lit(1), kept.cast("int")), edit)), F.lit(0).cast("long"))
    return F.when(kept < K, short).otherwise(F.concat(inside, _chosen(padded(seam, before=False), kept)))


def sketch(distinct: Column) -> Column:
    """The least of distinct anchor hashes, ascending."""
    return F.slice(F.sort_array(distinct), 1, SKETCH)


def likeness(a: Column, b: Column) -> Column:
    """Of two sets of anchor hashes, from 0 to 1."""
    common = F.size(F.array_intersect(a, b))
    either = lambda n: n / (F.size(a) + F.size(b) - n)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(let(common, either))


def as_text(sketched: Column) -> Column:
    """Eight lowercase hex digits for each hash."""
    return F.array_join(F.transform(sketched, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def _range_ends(keys: DataFrame, ranges: int) -> list[int]:
    """Exclusive ends of at most ``ranges`` ranges of ``k`` that hold about equally many bytes (column ``bytes``)."""
    fine = 8 * ranges
    cuts = sorted(set(keys.agg(F.percentile_approx("k", [i / fine for i in range(1, fine)], 10 * fine)).first()[0] or []))
    if not cuts:
        return [0]
    ends = [c + 1 for c in cuts]
    held = dict(keys.groupBy(interval_of(ends, F.col("k")).alias("i")).agg(F.sum("bytes")).collect())  # a row per fine range
    share, kept, filled = sum(held.values()) / ranges, [], 0.0
    for i, end in enumerate(ends):
        filled += held.get(i, 0)
        if filled >= share:
            kept.append(end)
            filled = 0.0
    return kept or [ends[-1]]


def in_order(docs: DataFrame, key: str, value: str, make, following: dict[str, str]) -> DataFrame:
    """``docs`` (key, value) with the columns that ``make`` adds to rows in place, and, for each entry of ``following``, the
    named column of the row that follows in ascending key (after the last: the first) under a new name.

    Keys are cut into ranges of about equally many bytes; each range's first rows are also sent to the range before it, and
    a window within each range finds the successor. Rows cross the network once, and what ``make`` adds never does.
    """
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    keys = cut(docs.select(order.alias("k"), (F.octet_length(value) + 32).alias("bytes")))
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    ends = _range_ends(keys, max(partitions(docs.sparkSession), -(-total // RANGE_BYTES)))
    range_of = lambda k: interval_of(ends, k)
    firsts = sorted(keys.groupBy(range_of(F.col("k")).alias("range")).agg(F.min("k").alias("first")).collect())  # a row per range
    first, before = [None] * (len(ends) + 1), [-1] * (len(ends) + 1)
    for i, (number, least) in enumerate(firsts):
        first[number], before[number] = least, firsts[i - 1]["range"]
    at = lambda values, kind: F.get(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), F.col("_veil_range"))
    rows = docs.select(key, value, order.alias("_veil_key"), F.xxhash64(value).alias("_veil_tie")).withColumn("_veil_range", range_of(F.col("_veil_key")))
    here = F.struct(F.col("_veil_range").alias("range"), F.lit(0).alias("guest"))
    both = F.array(here, F.struct(at(before, "int").alias("range"), F.lit(1).alias("guest")))
    rows = rows.select("*", F.inline(F.when(F.col("_veil_key") == at(first, "bigint"), both).otherwise(F.array(here)))).drop("_veil_range")
    rows = make(rows.repartitionById(len(ends) + 1, F.col("range")))
    window = W.partitionBy("range").orderBy("guest", "_veil_key", "_veil_tie")
    rows = rows.withColumns({new: F.lead(old).over(window) for old, new in following.items()}).where("guest = 0")
    return rows.drop("range", "guest", "_veil_key", "_veil_tie")


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with each whole text's fingerprint as text; a column of that name is replaced."""
    return df.withColumn(out, as_text(sketch(hashes(packed_anchors(F.coalesce(F.col(text), F.lit("")))))))


def positional_matches(a: DataFrame, b: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Where documents of ``a`` and of ``b`` share passages: side (a or b), doc_id, b_id, offset (position in b_id less that
    in doc_id), anchors, first and last position in doc_id.

    Each anchor hash is represented by one document of ``b``, that of the least id. All documents of both sides that hold
    the hash are matched with it, so that rows grow with the documents that share a passage and not with their pairs; two
    documents that share one are both matched with the same one. A document and hash count once (the first position).
    """
    sides = [
        d.select(F.lit(side).alias("side"), F.col(doc_id).alias("doc_id"), F.inline(anchors(F.coalesce(F.col(text), F.lit("")))))
        .groupBy("side", "doc_id", "hash").agg(F.min("position").alias("position"))
        for side, d in (("a", a), ("b", b))
    ]
    held, of_b = cut(sides[0].unionByName(sides[1])), F.col("side") == "b"
    known = held.groupBy("hash").agg(F.min(F.when(of_b, F.struct("doc_id", "position"))).alias("in_b"), F.count("*").alias("rows"))
    known = known.where("in_b is not null and rows > 1").select("hash", F.col("in_b.doc_id").alias("b_id"), F.col("in_b.position").alias("b_position"), "rows")
    met = joined(held, known, "hash", rows="rows").where(~(of_b & (F.col("doc_id") == F.col("b_id"))))
    return met.groupBy("side", "doc_id", "b_id", (F.col("b_position") - F.col("position")).alias("offset")).agg(
        F.count("*").alias("anchors"), F.min("position").alias("first"), F.max("position").alias("last")
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text (its last half replaced from the next document's beginning),
    their likeness, the likeness to the next document, the anchors of both texts and those that both have at one place."""
    whole = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    anchored = lambda rows: rows.withColumn("own", packed_anchors(F.col("text"))).withColumn("own_hashes", hashes(F.col("own")))
    rows = in_order(whole, "doc_id", "text", anchored, {"text": "next_text", "own_hashes": "next_hashes"})
    n = F.length("text").cast("long")
    rows = rows.withColumn("n_chars", n).withColumn("kept", F.col("n_chars") - F.floor(F.col("n_chars") / 2))
    edit = F.substring("next_text", F.lit(1), (F.col("n_chars") - F.col("kept")).cast("int"))
    rows = rows.withColumn("edit", edit)
    rows = rows.select(
        "doc_id", "n_chars", F.sha2(F.concat(F.substring("text", F.lit(1), F.col("kept").cast("int")), "edit").cast("binary"), 256).alias("edited_sha256"),
        "own", "own_hashes", "next_hashes", edited_anchors(F.col("text"), F.col("own"), F.col("kept"), F.col("edit")).alias("edited"),
    )
    rows = rows.withColumn("edited_hashes", hashes(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(sketch(F.col("own_hashes"))).alias("fingerprint"), as_text(sketch(F.col("edited_hashes"))).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
        F.size("own").cast("long").alias("anchors"), F.size("edited").cast("long").alias("edited_anchors"), F.size(F.array_intersect("own", "edited")).cast("long").alias("edited_in_place"),
    )
