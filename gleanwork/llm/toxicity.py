"""Toxicity by logistic regression with the FTRL-proximal update.

Features are hashed words, word starts, word pairs and pairs with one word left out, as
they occur or not. One task trains on a bounded sample of labelled rows, with a learning rate
per coordinate and L1 shrinkage. L1 leaves few weights, which fit a table of fixed size and
are sent to the scoring tasks. Averaging models of several tasks was tried and lost a third
of the recall, as each of them shrinks rare words to zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.llm.common import staged
from gleanwork.llm.hashing import WordHashes, mixed

BITS = 20  # of the feature space; no model has more than two to this power weights
ALPHA, BETA, L1, L2 = 0.7, 1.0, 5.0, 1.0
PASSES = 5
SAMPLE = 12_000  # labelled rows to learn from at most, the first by a hash of their id
THRESHOLD = 0.3
STARTS = (3, 4, 5)
_EDGES = b".,;:!?\"'()[]{}|*#$%&<>-_~`"


def _plain(word: bytes) -> bytes:
    """A word in lower case without the marks at its ends."""
    return word.decode("utf-8", "replace").lower().encode("utf-8", "replace").strip(_EDGES)


def _start(length: int):
    def cut(word: bytes) -> bytes:
        text = _plain(word).decode("utf-8", "replace")
        return text[:length].encode("utf-8", "replace") if len(text) > length else b""

    return cut


class Features:
    """Feature numbers of texts, repeats included; 0 is the bias and in every text."""

    def __init__(self):
        self._words = WordHashes(fold=_plain)
        self._starts = [WordHashes(seed=n, fold=_start(n)) for n in STARTS]

    def of(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").split()
        if not found:
            return np.zeros(1, dtype=np.int64)
        h = self._words.of(found)
        parts = [h, *[table.of(found) for table in self._starts]]
        for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
            if len(h) > gap:
                parts.append(mixed(h[:-gap] * np.uint64(factor) + h[gap:]))
        numbers = mixed(np.concatenate(parts)) >> np.uint64(64 - BITS)
        return np.append(numbers.astype(np.int64), 0)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def train(labelled: DataFrame, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights from rows ``doc_id, text, label``; null labels are left out.

    One task goes through all rows ``passes`` times, in the order of a hash, so the order of
    the input has no effect; the caller bounds their number. Features of a text count once.
    The model has at most ``2 ** BITS`` weights. Where L1 leaves none, as with few rows, its one
    weight is the bias that gives the share of ones; without rows that share is 0.
    """

    def learn(batches):
        features, rows = Features(), []
        for batch in batches:
            rows += [(np.unique(features.of(t)), float(y)) for t, y in zip(batch["text"], batch["label"])]
        if not rows:
            return
        z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for turn in range(passes):
            for x, y in rows:
                w = _weights(z[x], n[x])
                error = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
                rate = (np.sqrt(n[x] + error * error) - np.sqrt(n[x])) / ALPHA
                z[x] += error - rate * w
                n[x] += error * error
        w = _weights(z, n)
        kept = np.flatnonzero(w)
        yield pd.DataFrame({"feature": kept, "weight": w[kept]})

    rows = labelled.filter("label is not null").select("doc_id", "text", F.col("label").cast("double").alias("label"))
    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("text", "doc_id"), "label")
    found = ordered.select("text", "label").mapInPandas(learn, "feature bigint, weight double").toPandas()
    if not len(found):
        # too little to learn from: the share of ones decides, and without any label none is toxic
        share = rows.agg(F.avg("label")).first()[0] or 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(1, dtype=np.int64), np.array([np.log(share / (1 - share))])
    return found["feature"].to_numpy(dtype=np.int64), found["weight"].to_numpy(dtype=float)


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows with a ``score`` from 0 to 1; a text without words, or null, has the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: pd.Series) -> pd.Series:
        numbers, values = sent.value
        table = np.zeros(1 << BITS)
        table[numbers] = values
        features = Features()
        out = []
        for text in batches:
            x = features.of(text)
            x = np.unique(x[table[x] != 0])
            out.append(1 / (1 + np.exp(-np.clip(table[x].sum(), -30, 30))))
        return pd.Series(out, dtype=float)

    return docs.withColumn("score", score("text"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    Rows whose ``crc32`` of the id leaves 2 by division by four are held out and never
    learned from; without an id a row is not held out and has no label. An id labelled
    twice teaches twice. Learning takes ``sample`` labels at most; scoring takes every row.
    """
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    known = labels.select("doc_id", F.col("toxic").alias("label")).filter("doc_id is not null and label is not null")
    known = known.filter(~held_out).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    model = train(docs.select("doc_id", "text").join(staged(known, "known"), "doc_id"))
    df = scored(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return df.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
