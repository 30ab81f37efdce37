"""Packing: documents' token ids into fixed windows by minimum bin slack.

A document is its ids and a closing id. Full windows are cut off its front; what remains (shorter than a window) joins a
pool. Each next window takes the longest remaining piece, and a bitset subset-sum over the multiset of remaining lengths
(bit i of an integer: length i can be reached) finds the filling closest to capacity; the counts of each length are
traced back through the stored bitsets. Where the best filling leaves slack, the longest piece left is cut to fill it.
What is left at the end of an input partition is cut into lengths that are powers of two, which need no padding.

Everything happens in one pass over each input partition, without a shuffle; the pool is bounded by ``POOL_TOKENS`` and
one batch. Sequence ids hold the input partition's number in the upper bits.

Defined cases: a null or blank text is the closing id alone; documents of any length are cut; ties between equal lengths
go to the piece that came last; repeated rows are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from bisect import insort
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.llm.common import Recent, bounded_batches, kept_by_worker

CAPACITY, CLOSING_ID, ID_BYTES = 4096, 2, 4
#: Windows are taken from the pool while it holds more than this.
POOL_TOKENS = 96 * CAPACITY
#: A worker keeps the ids of so many words.
MOST_CACHED = 500_000
#: str.split() also splits at these, which the tokenizers do not count as white space.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Marks that, after letters, are a pre-token of their own.
TAIL = ".,!?;:*$%&#|)\"]"


def _byte_symbols() -> dict[int, str]:
    """How byte-level vocabularies write the bytes that are no visible character: from code point 256 on, in order."""
    hidden = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
    return {byte: chr(256 + i) for i, byte in enumerate(hidden)}


class Words(Recent):
    """Ids of words, as little-endian 32-bit bytes, found when first asked for.

    A word of letters with marks behind is two pre-tokens. Letters in lower case go straight to the vocabulary's merge
    model; whatever is not so simple goes through the whole tokenizer.
    """

    def __init__(self, tokenizer):
        super().__init__(self.ids_of, MOST_CACHED)
        self.tokenizer, self.merges, self.symbols = tokenizer, tokenizer.model.tokenize, _byte_symbols()

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids_of(self, word: str) -> bytes:
        letters = word.rstrip(TAIL)
        if not letters.isalpha() or "\u03a3" in letters or "\u0130" in letters:
            return self.encode(word)
        low = letters.lower()
        if low == word and is_normalized("NFC", low):
            symbols = low if low.isascii() else low.encode().decode("latin-1").translate(self.symbols)
            return array("I", [t.id for t in self.merges(symbols)]).tobytes()
        if low == word or not low.isalpha():
            return self.encode(word)
        return self[low] + (self[word[len(letters) :]] if len(letters) < len(word) else b"")


class Tokenizer:
    """Ids as little-endian 32-bit bytes. For a vocabulary of words without white space, each word's ids are found once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Loaded

        self.tokenizer = Loaded.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", ())]
        by_word = steps == ["NFC", "Replace", "Lowercase"] and parts["model"].get("end_of_word_suffix") == "</w>" and sys.byteorder == "little"
        self.words = Words(self.tokenizer) if by_word else None

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.words is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        self.words.turn()
        find = self.words.__getitem__
        return [self.words.encode(t) if t and SEPARATORS.search(t) else b"".join(map(find, (t or "").split())) for t in texts]


def best_filling(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """How many of each length to take for the largest sum up to ``capacity``. ``lengths``: those of ``counts``, ascending;
    longer ones are tried first, and the search ends once the capacity itself is reached."""
    mask = (1 << capacity + 1) - 1
    reached, states, used = 1, [], []
    for length in reversed(lengths):
        if length > capacity:
            continue
        states.append(reached)
        used.append(length)
        left, step = min(counts[length], capacity // length), 1
        while left:
            step = min(step, left)
            reached |= reached << length * step & mask
            left -= step
            step *= 2
        if reached >> capacity & 1:
            break
    goal, taken = reached.bit_length() - 1, {}
    for before, length in zip(reversed(states), reversed(used), strict=True):
        n = 0
        while not before >> goal & 1:
            goal -= length
            n += 1
        if n:
            taken[length] = n
    return taken


class Pool:
    """Remaining pieces by length. A piece is (document, start, ids as bytes)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.pieces: dict[int, list] = {}
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []
        self.tokens = 0

    def put(self, document, start: int, ids: bytes) -> None:
        length = len(ids) // ID_BYTES
        if not length:
            return
        if length not in self.pieces:
            self.pieces[length] = []
            self.counts[length] = 0
            insort(self.lengths, length)
        self.pieces[length].append((document, start, ids))
        self.counts[length] += 1
        self.tokens += length

    def take(self, length: int):
        piece = self.pieces[length].pop()
        self.counts[length] -= 1
        self.tokens -= length
        if not self.counts[length]:
            del self.pieces[length], self.counts[length]
            self.lengths.remove(length)
        return piece

    def window(self, size: int | None = None) -> list:
        """Pieces that fill a window of ``size`` exactly, or all that is left if that is less."""
        room, window = size or self.capacity, []
        if self.lengths and self.lengths[-1] <= room:
            room -= self.lengths[-1]
            window.append(self.take(self.lengths[-1]))
        for length, n in best_filling(self.counts, self.lengths, room).items():
            for _ in range(n):
                window.append(self.take(length))
                room -= length
        if room and self.lengths:
            document, start, ids = self.take(next((x for x in reversed(self.lengths) if x > room), self.lengths[-1]))
            window.append((document, start, ids[: room * ID_BYTES]))
            self.put(document, start + room, ids[room * ID_BYTES :])
        return window


def packed(documents: Iterable[list[tuple]], capacity: int = CAPACITY) -> Iterator[list[list]]:
    """Windows as lists of pieces. ``documents``: batches of (document, ids as bytes); a list of windows for each batch and
    one for what is left."""
    pool = Pool(capacity)
    for batch in documents:
        windows = []
        for document, ids in batch:
            whole = len(ids) // ID_BYTES // capacity * capacity
            for start in range(0, whole, capacity):
                windows.append([(document, start, ids[start * ID_BYTES : (start + capacity) * ID_BYTES])])
            pool.put(document, whole, ids[whole * ID_BYTES :])
        while pool.tokens > POOL_TOKENS:
            windows.append(pool.window())
        yield windows
    windows = []
    while pool.tokens:
        windows.append(pool.window(min(capacity, 1 << pool.tokens.bit_length() - 1)))
    yield windows


def padding(length: int, capacity: int) -> int:
    """Ids that fill a sequence up to the capacity; none where its length is a power of two."""
    return 0 if length & (length - 1) == 0 else capacity - length


PIECES = (
    T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("ids_crc32", T.LongType())
    .add("doc_tokens", T.LongType()).add("sequence_id", T.LongType()).add("offset", T.LongType())
)


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: the document's id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids``
    the piece's ids and padding: how many ids the sequence is padded by behind the piece (0 for all but its last one). Rows
    come in the order of sequence_id and offset, so that a reader of one file streams whole sequences. Other columns are
    left out."""
    bounded_batches(df.sparkSession)
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    source = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([source.schema["doc_id"], *PIECES.fields] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("padding", T.IntegerType())] * with_ids)
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, id_type = kept_by_worker(("packing", path), lambda: Tokenizer(path)), None

        def documents():
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("doc_id").type
                ids = tokenizer.encode(batch.column("text").to_pylist())
                yield [((d, len(i) // ID_BYTES + 1), i + closing) for d, i in zip(batch.column("doc_id").to_pylist(), ids, strict=True)]

        sequence = TaskContext.get().partitionId() << 36
        for windows in packed(documents(), capacity):
            rows = []
            for window in windows:
                offset = 0
                for number, ((document, doc_tokens), start, ids) in enumerate(window, 1):
                    length = len(ids) // ID_BYTES
                    row = (document, start, length, zlib.crc32(ids), doc_tokens, sequence, offset)
                    offset += length
                    rows.append((*row, np.frombuffer(ids, "<i4"), padding(offset, capacity) if number == len(window) else 0) if with_ids else row)
                sequence += 1
            if rows:
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:7]], *[pa.array(c, pa.list_(pa.int32())) for c in columns[7:8]], *[pa.array(c, pa.int32()) for c in columns[8:]]]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(pieces, schema)


def sequences(pieces: DataFrame, pad_id: int = 0) -> DataFrame:
    """The padded sequences themselves, from ``pack(..., with_ids=True)``: sequence_id, ids, n_tokens (without padding)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"), F.sum("length").alias("n_tokens"), F.sum("padding").cast("int").alias("padding"))
    return joined.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), F.col("padding"))).alias("ids"), "n_tokens")
