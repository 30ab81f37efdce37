"""Quality classifier: supervised subword embeddings.

Every word has a learned vector for its own hash and one for the hash of each of its character n-grams; a repetition (a
word equal to the one before) is a word of its own. A document is the average of all its vectors, a softmax layer gives
the label's probability, and both are trained by stochastic gradient descent in numpy. Since averaging and the layer are
linear, a trained word is one number and a count of vectors, which workers keep for its later occurrences.

Fitted on a bounded sample of the labelled rows (``PER_LABEL`` of each label, at most 6,000 code points of each text,
spread over it); scores every whole text.

Defined cases: null, empty and blank texts have no vectors and get the softmax of the bias; repeated rows get equal
scores; without any labelled row, with one label only, or with no word in any labelled text, every score is the positive
label's share (0.5 for none); a label other than 1 counts as 0; of several labels of one id the least counts; of several
texts of a labelled id one is learned from.
"""

from __future__ import annotations

import zlib
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.llm.common import Recent, bounded_batches, crc_mod, give_back, kept_by_worker, labelled_sample, spread_pieces

BUCKETS, DIMENSIONS, GRAMS = 1 << 17, 10, (3, 4)
REPEATED = "\0same"
#: The sample's bound, words drawn from each of its documents in an epoch; small samples get more epochs, for LEAST_STEPS.
PER_LABEL, WORDS_PER_DRAW, EPOCHS, LEAST_STEPS, BATCH = 1200, 160, 6, 400, 32
#: Learning rates. A vector gets a hundredth or less of a document's gradient, as the average is over hundreds of them, and so
#: a rate higher by as much; the bias gets the whole of every document's, and a rate lower than the layer's.
LAYER_RATE, VECTOR_RATE, BIAS_RATE = 8.0, 800.0, 1.0
HELD_OUT_MODULUS, HELD_OUT_REST = 4, 2
THRESHOLD = 0.7
MOST_CACHED = 400_000


def word_features(word: str) -> list[int]:
    """Buckets of the word and of its n-grams, with marks at its ends."""
    if word == REPEATED:
        return [zlib.crc32(b"r")]
    marked = f"<{word}>"
    out = [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) % BUCKETS]
    for n in GRAMS:
        out += [zlib.crc32(marked[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


def words_of(text: str | None) -> list[str]:
    words = (text or "").split()
    return words + [REPEATED] * sum(map(eq, words, islice(words, 1, None)))


def train(texts: list[str], labels: list[int], seed: int = 11) -> tuple[np.ndarray, float]:
    """For each bucket the difference of logits that its vector makes, and the bias."""
    y = np.array(labels, np.int64)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t in texts]
    if len(set(labels)) < 2 or not vocabulary:
        share = (y.sum() + 0.5 * (not len(y))) / max(1, len(y))
        return np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    features = [np.array(word_features(w), np.int64) % BUCKETS for w in vocabulary]
    sizes = np.array([len(f) for f in features])
    begins, flat = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([*features, np.zeros(0, np.int64)])

    random = np.random.default_rng(seed)
    vectors = random.uniform(-0.1, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    in_epoch = -(-len(docs) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // in_epoch))
    steps, step = epochs * in_epoch, 0
    for _ in range(epochs):
        order = random.permutation(len(docs))
        for at in range(0, len(docs), BATCH):
            rows = order[at : at + BATCH]
            drawn = [d if len(d) <= WORDS_PER_DRAW else d[random.integers(0, len(d), WORDS_PER_DRAW)] for d in (docs[r] for r in rows)]
            words = np.concatenate(drawn)
            owner = np.repeat(np.arange(len(rows)), [len(d) for d in drawn])
            counts = sizes[words]
            ids = flat[np.repeat(begins[words] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())] if len(words) else np.zeros(0, np.int64)
            of = np.repeat(owner, counts)
            n = np.maximum(1, np.bincount(of, minlength=len(rows))).astype(np.float32)
            hidden = np.stack([np.bincount(of, vectors[ids, k], len(rows)) for k in range(DIMENSIONS)], 1).astype(np.float32) / n[:, None]
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= (1 - step / steps) / len(rows)
            step += 1
            back = p @ layer.T / n[:, None] * VECTOR_RATE
            layer -= LAYER_RATE * hidden.T @ p
            bias -= BIAS_RATE * p.sum(0)
            if len(ids):
                by = np.argsort(ids, kind="stable")
                unique, first = np.unique(ids[by], return_index=True)
                vectors[unique] -= np.add.reduceat(back[of[by]], first)
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    """A worker's words for one model, each with its vectors' sum of logits. A word of n code points has 2n vectors: its own,
    n 3-grams and n - 1 4-grams, marks included."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.repeated = self._sum(REPEATED)
        self.words = Recent(self._sum, MOST_CACHED)

    def _sum(self, word: str) -> float:
        return float(self.weights[np.array(word_features(word)) % BUCKETS].sum(dtype=np.float64))

    def scores(self, texts) -> list[float]:
        self.words.turn()
        out, find = [], self.words.__getitem__
        for text in texts:
            words = (text or "").split()
            repeats = sum(map(eq, words, islice(words, 1, None)))
            n = 2 * sum(map(len, words)) + repeats
            logit = self.bias + ((sum(map(find, words)) + repeats * self.repeated) / n if n else 0.0)
            out.append(float(1 / (1 + np.exp(-logit))))
        return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, float]:
    """The model from the labelled rows that are not held out."""
    known = labels.select(F.col(doc_id).alias("_veil_id"), (F.col(label).cast("int") == 1).cast("int").alias("_veil_label")).where(F.col("_veil_id").isNotNull())
    known = known.where(crc_mod("_veil_id", HELD_OUT_MODULUS) != HELD_OUT_REST).groupBy("_veil_id").agg(F.min("_veil_label").alias("_veil_label"))
    drawn = labelled_sample(known, "_veil_label", PER_LABEL, {"_veil_id": F.col("_veil_id")}, [F.col("_veil_id")])
    if not drawn:
        return train([], [])
    sample = docs.sparkSession.createDataFrame([(r["_veil_id"], r["_veil_label"]) for r in drawn], known.schema)
    texts = docs.select(F.col(doc_id).alias("_veil_id"), F.col(text).alias("_veil_text")).join(F.broadcast(sample), "_veil_id")
    texts = texts.select("_veil_id", "_veil_label", F.concat_ws("\n", spread_pieces(F.col("_veil_text"))).alias("_veil_text"))
    # the sample is bounded by PER_LABEL of each label, and one text of each id is kept, however many share it
    rows = texts.groupBy("_veil_id", "_veil_label").agg(F.min_by("_veil_text", F.xxhash64("_veil_text")).alias("_veil_text")).collect()
    rows.sort(key=lambda r: r["_veil_id"])
    model = train([r["_veil_text"] for r in rows], [int(r["_veil_label"] == 1) for r in rows])
    del rows
    give_back()
    return model


def with_score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; a column of that name is replaced."""
    bounded_batches(docs.sparkSession)
    weights, bias = model
    name = ("quality", zlib.crc32(weights.tobytes(), zlib.crc32(np.float64(bias).tobytes())))

    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(kept_by_worker(name, lambda: Scorer(weights, bias)).scores(texts), dtype="float64")

    return docs.withColumn(out, F.pandas_udf(scored, T.DoubleType())(F.col(text)))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's doc_id, held_out, score and predicted."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    held_out = crc_mod("doc_id", HELD_OUT_MODULUS) == HELD_OUT_REST
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
