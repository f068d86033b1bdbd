"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector passes it if their inner product exceeds a threshold. The
directions are a product code: the coordinates are cut into blocks, each block has a few
random codewords, and every combination of codewords is a direction. So a vector finds the
filters it passes from a few sums per block (list decoding) without trying all of them.
Vectors that share a filter are compared exactly.

The threshold lies at four standard deviations of a random inner product. Most vectors pass
one to a few dozen filters of a code, and every one counts as passing its best. A pair at
cosine 0.95 shares a filter of one code with probability near 0.45, so ``CODES`` independent
codes miss about one in a hundred; the tests measure it on planted pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.llm.common import staged
from gleanwork.llm.components import components

SIMILAR = 0.95
BLOCKS = 4
CODEWORDS = 32
CODES = 8
DEVIATIONS = 4.0


def _codewords(width: int, code: int, block: int) -> np.ndarray:
    rng = np.random.default_rng([width, code, block])
    words = rng.standard_normal((CODEWORDS, width))
    return words / np.linalg.norm(words, axis=1, keepdims=True)


def passed_filters(unit: np.ndarray, code: int) -> np.ndarray:
    """Numbers of the filters of one code that a unit vector passes, at least its best one.

    Sums of the first half of the blocks are looked up among the sorted sums of the second.
    """
    parts = np.array_split(unit, min(BLOCKS, len(unit)))
    sums = [_block_words[(len(p), code, k)] @ p for k, p in enumerate(parts)]
    half = (len(sums) + 1) // 2
    sides = []
    for side in (sums[:half], sums[half:]):
        total = np.zeros(1)
        for s in side:
            total = (total[:, None] + s[None, :]).ravel()
        sides.append(total)
    first, second = sides
    order = np.argsort(second)
    ranked = second[order]
    need = DEVIATIONS / np.sqrt(len(unit)) * np.sqrt(len(parts))
    need = min(need, first.max() + ranked[-1])
    found = [i * len(second) + order[np.searchsorted(ranked, need - first[i] - 1e-12) :] for i in np.flatnonzero(first + ranked[-1] >= need - 1e-12)]
    return np.concatenate(found)


class _Words(dict):
    def __missing__(self, key):
        self[key] = _codewords(*key)
        return self[key]


_block_words = _Words()


def _doubles(values) -> np.ndarray | None:
    """A vector that has a direction, as doubles; else None."""
    if values is None or not len(values):
        return None
    x = np.array([np.nan if v is None else v for v in values], dtype=np.float64)
    return x if np.isfinite(x).all() and x.any() else None


@F.pandas_udf(T.BinaryType())
def _content(vectors: pd.Series) -> pd.Series:
    """Doubles of a vector, scaled to length one; null if it has no direction."""
    out = []
    for values in vectors:
        x = _doubles(values)
        if x is not None:
            x = x / np.abs(x).max()
            x = (x / np.linalg.norm(x)).tobytes()
        out.append(x)
    return pd.Series(out, dtype=object)


def _filters(classes: DataFrame) -> DataFrame:
    def rows(batches):
        for batch in batches:
            ids, found = [], []
            for vec, unit in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(unit.as_py(), dtype=np.float64)
                for code in range(CODES):
                    passed = passed_filters(x, code)
                    ids.append(np.full(len(passed), vec, dtype=np.int64))
                    found.append((passed.astype(np.int64) * CODES + code) * 4096 + len(x))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found))], ["v", "filter"])

    return classes.select("v", "unit").mapInArrow(rows, "v bigint, filter bigint")


@F.pandas_udf(T.BooleanType())
def _close(a: pd.Series, b: pd.Series) -> pd.Series:
    cosine = [float(np.frombuffer(x, dtype=np.float64) @ np.frombuffer(y, dtype=np.float64)) for x, y in zip(a, b)]
    return pd.Series(np.array(cosine) >= SIMILAR, dtype=bool)


def near_vectors(table: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``table(vec_id, embedding)``.

    Links have a cosine of at least 0.95 in doubles. Rows with one direction are one class
    and are not paired with each other; their links are counted. Vectors that are null,
    empty, zero or hold null or non-finite parts link with nothing, and so do rows without
    an id, which have no component and are kept. Vectors of different lengths never link.
    """
    rows = staged(table.select("vec_id", _content("embedding").alias("unit")), "units")
    valid = rows.filter("unit is not null and vec_id is not null")
    classes = valid.groupBy("unit").agg(F.min("vec_id").alias("v"), F.count(F.lit(1)).alias("copies"))
    classes = staged(classes, "classes")
    filters = staged(_filters(classes), "filters")
    theirs = filters.select("filter", F.col("v").alias("b"))
    pairs = filters.select("filter", F.col("v").alias("a")).join(theirs, "filter").filter("a < b").select("a", "b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("v").alias(side), F.col("unit").alias(f"unit_{side}"), F.col("copies").alias(f"copies_{side}")), side)
    links = staged(pairs.filter(_close("unit_a", "unit_b")).select("a", "b", "copies_a", "copies_b"), "links")
    labels = components(links)
    ends = links.select(F.col("a").alias("v"), F.col("copies_b").alias("n")).union(links.select("b", "copies_a"))
    linked = ends.groupBy("v").agg(F.sum("n").alias("n"))
    known = classes.join(linked, "v", "left").join(labels, "v", "left")
    known = staged(known.select("unit", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("c", "v").alias("component_id")), "known")
    df = valid.join(known, "unit").drop("unit")
    alone = rows.filter("unit is null or vec_id is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    df = df.union(alone.select(df.columns))
    return df.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
