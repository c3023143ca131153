"""Language identification by a string kernel with Nyström landmarks.

The kernel of two texts is the number of character n-grams (1 to ``SPECTRUM``) that both have,
divided by the geometric mean of their own numbers; n-grams that no landmark has are not counted.
Texts map to ``K(x, Z) K(Z, Z)^(-1/2)`` for landmarks ``Z``; each language has a kernel ridge
regression against the rest. All of it after a text's 0/1 row of n-grams is one matrix, so a batch
of texts is scored by one matrix product.

The classifier is fitted on ``TRAIN_ROWS`` labelled texts for each language, about, chosen by a
hash, and on ``TRAIN_CHARS`` characters of each at most; everything else covers all rows and whole texts. The fit
keeps one block of rows of n-grams at a time, so the driver's memory grows with languages and landmarks only.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_map, table

SPECTRUM, FEATURE_BITS = 3, 18
#: Labelled texts and landmarks for each language, about; the ridge; characters of a text that is learned from.
TRAIN_ROWS, LANDMARKS, RIDGE, TRAIN_CHARS = 300, 40, 1e-2, 20_000
#: Training texts that are one dense block of the fit.
BLOCK = 512
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]")
_M = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]
#: Code points below 0x250 that are no letters count as a space.
_PLAIN = np.array([c if chr(c).isalpha() else 32 for c in range(0x250)], np.uint32)


def has_letter(text: str) -> bool:
    """Whether a character is a letter; a fraction or a raised digit is none, though it is a word's part."""
    return any(m[0].isalpha() for m in WORD.finditer(text))


def grams(text: str) -> np.ndarray:
    """Hashed n-grams of a whole text, with repeats."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.where(c < 0x250, _PLAIN[np.minimum(c, 0x24F)], c)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(min(SPECTRUM, len(c))):
        h = (h[: len(c) - n] * _M[0]) ^ (c[n:] * _M[1])
        out.append(((h ^ np.uint32(n * 0x51ED27)) * _M[2]) >> np.uint32(32 - FEATURE_BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


class Classifier:
    """``langs``, and for each n-gram that a landmark has its weight for each of them."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> None:
        self.langs = sorted(set(langs))
        y = np.array([self.langs.index(x) for x in langs])
        chosen = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(self.langs))])
        present = np.zeros(1 << FEATURE_BITS, bool)
        for i in chosen:
            present[grams(texts[i])] = True
        self.column = np.full(1 << FEATURE_BITS, -1, np.int32)
        self.column[present] = np.arange(present.sum())
        self.width = int(present.sum())
        z = self.normed([texts[i] for i in chosen])
        values, vectors = np.linalg.eigh((z @ z.T).astype(float))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])  # K(Z, Z)^(-1/2), up to a rotation
        features = np.concatenate([self.normed(texts[i : i + BLOCK]) @ z.T for i in range(0, len(texts), BLOCK)]) @ root
        mean = features.mean(0)
        target = np.where(y[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        centred = features - mean
        w = np.linalg.solve(centred.T @ centred + ridge * len(texts) / 100 * np.eye(centred.shape[1]), centred.T @ (target - target.mean(0)))
        self.weights = (z.T @ (root @ w)).astype(np.float32)
        self.bias = (target.mean(0) - mean @ w).astype(np.float32)

    def normed(self, texts: list[str]) -> np.ndarray:
        x = self.rows(texts)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    def rows(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width + 1), np.float32)
        for i, text in enumerate(texts):
            out[i, self.column[grams(text)]] = 1  # what no landmark has falls in the last column
        return out[:, : self.width]

    def scores(self, texts: list[str]) -> np.ndarray:
        x = self.rows(texts)
        return (x @ self.weights) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t and has_letter(t)]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for at in range(0, len(known), 256):
            part = known[at : at + 256]
            s = self.scores([texts[i] for i in part])
            e = np.exp(4 * (s - s.max(1, keepdims=True)))
            e /= e.sum(1, keepdims=True)
            for i, k, p in zip(part, s.argmax(1).tolist(), e.max(1).tolist(), strict=True):
                langs[i], scores[i] = self.langs[k], min(1.0, float(p))
        return langs, scores


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Classifier | None:
    """A classifier from the labelled texts of ``docs`` that are not held out; None without any.
    Of languages with many, a share by hash that gives ``rows`` on average."""
    known = docs.where(~held_out(docs["doc_id"]) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.substring("text", 1, TRAIN_CHARS).alias("text"))
    # One row a language.
    shares = known.groupBy("lang").agg(F.floor(F.least(F.lit(1.0), rows / F.count(F.lit(1))) * 1_000_000).alias("share"))
    chosen = known.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share")).select("doc_id", "lang", "text")
    sample = sorted(r for r in chosen.collect() if has_letter(r["text"]))
    return Classifier([r["text"] for r in sample], [r["lang"] for r in sample]) if sample else None


SCHEMA = "doc_id long, lang_pred string, score double"


def predict(docs: DataFrame, model: Classifier | None) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        langs, scores = held.value.predict(texts) if held.value else ([UNKNOWN] * len(texts), [0.0] * len(texts))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text, lang).

    ``und`` with score 0 for a null text or one without a letter, and for all if nothing is
    labelled. Rows whose doc_id is null are not learned from and not held out. Repeated rows are
    predicted one by one; ties between languages go to the first by name; an empty table gives
    an empty result; other columns are not read.
    """
    out = predict(docs, train(docs))
    return out.select("doc_id", F.coalesce(held_out(out["doc_id"]), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op9_language_id": op9_language_id}
ORACLE_SQL: dict = {}
