"""Packing documents into sequences along a space-filling curve.

Hashed counts of a document's short runs of bytes are projected to three dimensions, and the place on a
Hilbert curve through them is its sort key. Documents are sorted by range over all tasks,
so one task has neighbours on the curve; it lays their tokens end to end and cuts them into
sequences. Only the last sequence of a task can be short.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.llm.tokens import Tokens, default_path

LENGTH = 1024
END = 0
BUCKETS = 256  # by the upper eight bits of a 32-bit hash
DIMENSIONS = 3
BITS = 16
SPREAD = 2.0  # projections of unit vectors beyond this lie on the cube's faces


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates below ``2**bits``.

    From the highest bit down, the part of the cube that holds a point is turned so that
    the curve enters and leaves it alike; the turned coordinates in Gray code are the place.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in range(n):
            high = (x[axis] >> level) & 1
            swap = np.where(high == 1, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(high == 1, low, swap)
            x[axis] ^= swap if axis else 0
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            place = (place << 1) | ((x[axis] >> level) & 1)
    return place


@F.pandas_udf(T.LongType())
def curve_place(texts: pd.Series) -> pd.Series:
    """Place of each text on the curve; a text of fewer than four bytes lies in the middle.

    The vector counts a text's runs of four bytes by a hash.
    """
    vectors = np.zeros((len(texts), BUCKETS))
    for row, text in enumerate(texts):
        x = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
        if len(x) < 4:
            continue
        h = ((x[:-3] * np.uint32(31) + x[1:-2]) * np.uint32(31) + x[2:-1]) * np.uint32(31) + x[3:]
        buckets = (h * np.uint32(2654435761)) >> np.uint32(24)
        vectors[row] = np.log1p(np.bincount(buckets, minlength=BUCKETS))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    axes = np.random.default_rng(5).standard_normal((BUCKETS, DIMENSIONS))
    top = (1 << BITS) - 1
    cube = np.clip((vectors @ axes + SPREAD) / (2 * SPREAD), 0, 1)
    return pd.Series(hilbert(np.rint(cube * top)))


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each row of ``docs(doc_id, text)`` is its token ids and one end id, also a null or empty
    text, so repeated rows are packed as often as they occur. Every id lies in one piece;
    pieces fill a sequence without gaps. ``with_ids`` adds the ids. Equal texts are spread
    over the tasks by id, and a task holds one batch of documents at a time.
    """
    path = tokenizer or default_path()

    def cut(batches):
        ids_of = Tokens(path)
        sequence, filled = TaskContext.get().partitionId() << 36, 0
        names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            rows, owners, parts = {name: [] for name in names}, [], []
            for number, text in enumerate(batch.column(1)):
                ids = np.append(ids_of.of(text.as_py() or ""), np.uint32(END)).astype("<u4")
                start = 0
                while start < len(ids):
                    n = min(length - filled, len(ids) - start)
                    piece = ids[start : start + n]
                    for name, value in zip(names, (start, n, zlib.crc32(piece.tobytes()), len(ids), sequence, filled)):
                        rows[name].append(value)
                    owners.append(number)
                    if with_ids:
                        parts.append(piece.astype(np.int32))
                    start, filled = start + n, filled + n
                    if filled == length:
                        sequence, filled = sequence + 1, 0
            arrays = [batch.column(0).take(pa.array(owners, pa.int64())), *[pa.array(rows[name], pa.int64()) for name in names]]
            if with_ids:
                arrays.append(pa.array(parts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, *["ids"] * with_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    placed = docs.select("doc_id", "text", curve_place("text").alias("place"))
    ordered = placed.repartitionByRange("place", "doc_id").sortWithinPartitions("place", "doc_id")
    return ordered.select("doc_id", "text").mapInArrow(cut, schema + ", ids array<int>" * with_ids)
