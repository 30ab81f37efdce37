"""Language identification: a byte convolutional network in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, the maximum of each filter over the window
is pooled, and a softmax layer gives the languages. Every byte of a text lies in a window; a text's scores are its
windows' averaged logits, weighed by their bytes. Trained by Adam on windows of a bounded sample of labelled rows
(``PER_LANGUAGE`` documents of each language, ``common.SAMPLE_ROWS`` in all, at most ``WINDOWS_PER_DOCUMENT`` windows of
each, spread over the text).

Defined cases: a text that is null or holds no letter is ``und`` with score 0; without any labelled row every other text
is ``und`` too; with one language every text with a letter is that language; repeated rows get equal rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.llm.common import bounded_batches, crc_mod, give_back, kept_by_worker, labelled_sample, spread_pieces

WINDOW, EMBEDDED, WIDTHS, FILTERS = 160, 8, (2, 3, 4, 5), 8
WIDEST = max(WIDTHS)
PER_LANGUAGE, WINDOWS_PER_DOCUMENT, EPOCHS, LEAST_STEPS, BATCH, RATE = 500, 6, 8, 400, 64, 0.004
HELD_OUT_MODULUS, HELD_OUT_REST = 3, 1
UNDETERMINED = "und"
#: Windows that go through the network at once.
CHUNK = 128


def windows_of(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All fixed-length windows of these byte strings, each with its string's number and its own bytes; zeros fill the rest."""
    lengths = np.array([len(d) for d in data], np.int64)
    counts = -(-lengths // WINDOW)
    begins = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(int(begins[-1]) * WINDOW, np.uint8)
    for d, begin in zip(data, begins, strict=False):
        flat[begin * WINDOW : begin * WINDOW + len(d)] = np.frombuffer(d, np.uint8)
    owner = np.repeat(np.arange(len(data)), counts)
    sizes = np.full(len(owner), WINDOW, np.int64)
    last = begins[1:][counts > 0] - 1
    sizes[last] = lengths[counts > 0] - (counts[counts > 0] - 1) * WINDOW
    return flat.reshape(-1, WINDOW), owner, sizes


class Network:
    def __init__(self, languages: list[str], seed: int = 5):
        random = np.random.default_rng(seed)
        self.languages = languages
        total = FILTERS * len(WIDTHS)
        self.bytes = random.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32)
        self.bytes[0] = 0
        self.filters = np.zeros((WIDEST * EMBEDDED, total), np.float32)
        self.mask = np.zeros_like(self.filters)
        for i, width in enumerate(WIDTHS):
            own = slice(i * FILTERS, (i + 1) * FILTERS)
            self.mask[: width * EMBEDDED, own] = 1
            self.filters[: width * EMBEDDED, own] = random.normal(0, (width * EMBEDDED) ** -0.5, (width * EMBEDDED, FILTERS))
        self.offset = np.zeros(total, np.float32)
        self.layer = random.normal(0, total**-0.5, (total, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """For each byte of each window the embeddings of it and of its successors (none beyond the window), in a row."""
        n = len(windows)
        embedded = np.zeros((n, WINDOW + WIDEST - 1, EMBEDDED), np.float32)
        embedded[:, :WINDOW] = self.bytes[windows]
        s = embedded.strides
        return np.lib.stride_tricks.as_strided(embedded, (n, WINDOW, WIDEST * EMBEDDED), (s[0], s[1], s[2])).reshape(n * WINDOW, -1)

    def _pooled(self, columns: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return (columns @ self.filters).reshape(n, WINDOW, -1), self.offset

    def logits(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), CHUNK):
            part = windows[at : at + CHUNK]
            convolved, offset = self._pooled(self._columns(part), len(part))
            out[at : at + CHUNK] = np.maximum(convolved.max(1) + offset, 0) @ self.layer + self.bias
        return out

    def train(self, windows: np.ndarray, labels: np.ndarray, seed: int = 6) -> Network:
        random = np.random.default_rng(seed)
        parts = {"bytes": self.bytes, "filters": self.filters, "offset": self.offset, "layer": self.layer, "bias": self.bias}
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in parts.items()}
        in_epoch = -(-len(windows) // BATCH)
        epochs = max(EPOCHS, -(-LEAST_STEPS // in_epoch))
        step, steps = 0, epochs * in_epoch
        for _ in range(epochs):
            order = random.permutation(len(windows))
            for at in range(0, len(windows), BATCH):
                rows = order[at : at + BATCH]
                batch, n = windows[rows], len(rows)
                columns = self._columns(batch)
                convolved, offset = self._pooled(columns, n)
                best = convolved.argmax(1)
                pooled = np.take_along_axis(convolved, best[:, None], 1)[:, 0] + offset
                hidden = np.maximum(pooled, 0)
                logits = hidden @ self.layer + self.bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), labels[rows]] -= 1
                p /= n
                back = (p @ self.layer.T) * (pooled > 0)
                at_best = columns[(np.arange(n)[:, None] * WINDOW + best).ravel()].reshape(n, -1, WIDEST * EMBEDDED)
                to_columns = back[:, :, None] * self.filters.T[None]
                gradient_bytes = np.zeros_like(self.bytes)
                places = np.minimum(best[:, :, None] + np.arange(WIDEST), WINDOW)
                extended = np.concatenate([batch, np.zeros((n, 1), np.uint8)], 1)
                ids = np.take_along_axis(extended, places.reshape(n, -1), 1).ravel()
                flat = to_columns.reshape(-1, EMBEDDED)
                for k in range(EMBEDDED):
                    gradient_bytes[:, k] = np.bincount(ids, flat[:, k], 256)
                gradient_bytes[0] = 0
                gradients = {"bytes": gradient_bytes, "filters": np.einsum("nfc,nf->cf", at_best, back) * self.mask, "offset": back.sum(0), "layer": hidden.T @ p, "bias": p.sum(0)}
                step += 1
                rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
                for k, g in gradients.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    parts[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        return self

    def predict(self, texts) -> list[tuple[str, float]]:
        texts = [t if t and any(map(str.isalpha, t)) else None for t in texts]
        if not self.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        windows, owner, sizes = windows_of([(t or "").encode("utf-8", "surrogatepass") for t in texts])
        logits = self.logits(windows).astype(np.float64) * sizes[:, None]
        sums = np.stack([np.bincount(owner, logits[:, k], len(texts)) for k in range(logits.shape[1])], 1)
        mean = sums / np.maximum(1, np.bincount(owner, sizes, len(texts)))[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [(UNDETERMINED, 0.0) if t is None else (self.languages[b], float(row[b])) for t, b, row in zip(texts, best, p, strict=True)]


def fit_network(rows: list[tuple[str, list[str]]]) -> Network:
    """From (language, pieces of a text) rows."""
    languages = sorted({language for language, _ in rows})
    network = Network(languages)
    if len(languages) < 2:
        return network
    kept, labels = [], []
    for language, pieces in rows:
        windows, _, _ = windows_of([(p or "").encode("utf-8", "surrogatepass") for p in pieces])
        if len(windows):
            chosen = windows[np.unique(np.linspace(0, len(windows) - 1, WINDOWS_PER_DOCUMENT).astype(int))]
            kept.append(chosen)
            labels += [languages.index(language)] * len(chosen)
    return network.train(np.concatenate(kept), np.array(labels)) if kept else network


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network:
    """The network from a bounded sample of the rows that are not held out."""
    known = docs.select(F.col(doc_id).alias("_veil_id"), F.col(lang).cast("string").alias("_veil_lang"), F.col(text).alias("_veil_text"))
    known = known.where((crc_mod("_veil_id", HELD_OUT_MODULUS) != HELD_OUT_REST) & F.col("_veil_text").isNotNull())
    rows = labelled_sample(known, "_veil_lang", PER_LANGUAGE, {"_veil_pieces": spread_pieces(F.col("_veil_text"))}, [F.col("_veil_id"), F.col("_veil_text")])
    network = fit_network([(r["_veil_lang"], r["_veil_pieces"]) for r in rows])
    del rows
    give_back()
    return network


PREDICTION = T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType())


def with_language(docs: DataFrame, network: Network, text: str = "text", out: str = "_veil_language") -> DataFrame:
    """``docs`` with the struct column ``out`` (lang_pred, score) for each whole text; a column of that name is replaced."""
    bounded_batches(docs.sparkSession)

    def predicted(texts: pd.Series) -> pd.DataFrame:
        kept_by_worker()
        return pd.DataFrame(network.predict(texts), columns=PREDICTION.names)

    return docs.withColumn(out, F.pandas_udf(predicted, PREDICTION)(F.col(text)))


def predictions(docs: DataFrame) -> DataFrame:
    """Every document's doc_id, held_out, lang_pred and score."""
    predicted = with_language(docs.select("doc_id", "text"), fit(docs))
    held_out = crc_mod("doc_id", HELD_OUT_MODULUS) == HELD_OUT_REST
    return predicted.select("doc_id", held_out.alias("held_out"), "_veil_language.lang_pred", "_veil_language.score")
