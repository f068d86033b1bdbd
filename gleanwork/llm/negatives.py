"""Hard negatives by rotated one-bit codes with exact intervals.

A vector is rotated and each coordinate keeps its sign alone: a code vector. Its alignment,
the inner product with the vector, is stored; what it leaves over is rotated and coded
again, ``CODES`` times, and the length of the last remainder is stored. An anchor is rotated
alike and quantised to ``PLANES`` bits, so its inner product with a code vector is a sum of
popcounts. Two terms stay unknown and are bounded by Cauchy-Schwarz: what quantisation lost,
and the remainder, which meets only the part of the anchor that its last code vector does
not. That gives an interval that surely holds the score. Rows whose interval cannot reach the
best ones are passed over; the rest get their integer score.

Anchors and rows meet in a grid of blocks, so a task holds ``BLOCK`` rows and ``ANCHORS``
anchors at most, and a block returns a few rows per anchor. The work is anchors times rows
by nature, each pair costing a few words of code.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.llm.common import staged
from gleanwork.session import staged_metrics

CODES = 4
PLANES = 7
SCALE = 256
BEST = 5
BLOCK, ANCHORS = 65_536, 1024
LEAST_BLOCKS = 32  # so that small tables are spread too
LABELS = 10
# Relative slack for rounding in doubles, far above what it can amount to.
SLACK = 1e-9


@lru_cache(maxsize=64)
def rotation(width: int, code: int) -> np.ndarray:
    """A random rotation, the same in every task."""
    rng = np.random.default_rng([width, code, 13])
    q, r = np.linalg.qr(rng.standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    short = -bits.shape[-1] % 64
    bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], short), dtype=bool)], axis=-1)
    return np.packbits(bits, axis=-1).view(np.uint64)


class Coded:
    """Codes, alignments and remainders of rows."""

    def __init__(self, bits: np.ndarray, align: np.ndarray, left: np.ndarray):
        self.bits, self.align, self.left = bits, align, left

    @classmethod
    def of(cls, x: np.ndarray) -> Coded:
        """Of the rows of an integer matrix."""
        n, width = x.shape
        rest = x.astype(np.float64)
        bits, align = [], []
        for code in range(CODES):
            rest = rest @ rotation(width, code).T
            up = rest >= 0
            bits.append(_words(up))
            align.append(np.abs(rest).sum(axis=1) / np.sqrt(width))
            rest = rest - (align[-1] / np.sqrt(width))[:, None] * np.where(up, 1.0, -1.0)
        return cls(np.stack(bits), np.stack(align), np.linalg.norm(rest, axis=1))

    def stored(self) -> list[bytes]:
        """One binary per row: the bits, then alignments and remainder as doubles."""
        n = len(self.left)
        numbers = np.concatenate([self.align, self.left[None]]).T.copy().view(np.uint64)
        return [row.tobytes() for row in np.concatenate([self.bits.transpose(1, 0, 2).reshape(n, -1), numbers], axis=1)]

    @classmethod
    def read(cls, codes: list[bytes]) -> Coded:
        both = np.frombuffer(b"".join(codes), dtype=np.uint64).reshape(len(codes), -1)
        bits, numbers = both[:, : -CODES - 1], both[:, -CODES - 1 :].copy().view(np.float64)
        return cls(bits.reshape(len(codes), CODES, -1).transpose(1, 0, 2), numbers[:, :CODES].T, numbers[:, CODES])

    def take(self, at: np.ndarray) -> Coded:
        return Coded(self.bits[:, at], self.align[:, at], self.left[at])


class Asked:
    """An anchor against coded rows: intervals of the inner products."""

    def __init__(self, y: np.ndarray):
        self._width = width = len(y)
        self._length = float(np.linalg.norm(y.astype(np.float64)))
        self._parts = []
        w = y.astype(np.float64)
        for code in range(CODES):
            w = rotation(width, code) @ w
            low = w.min()
            step = (w.max() - low) / ((1 << PLANES) - 1) or 1.0
            q = np.rint((w - low) / step).astype(np.int64)
            planes = [_words((q >> p & 1).astype(bool)) for p in range(PLANES)]
            lost = float(np.linalg.norm(w - (low + step * q)))
            self._parts.append((low, step, int(q.sum()), planes, lost))

    def interval(self, rows: Coded) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros(rows.align.shape[1])
        doubt = np.zeros_like(total)
        root = np.sqrt(self._width)
        for code, (low, step, q_sum, planes, lost) in enumerate(self._parts):
            bits = rows.bits[code]
            ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            dot = np.zeros(len(bits), dtype=np.int64)
            for p, plane in enumerate(planes):
                dot += np.bitwise_count(bits & plane).sum(axis=1, dtype=np.int64) << p
            # signs are twice the bits less one
            met = (low * (2 * ones - self._width) + step * (2 * dot - q_sum)) / root
            total += rows.align[code] * met
            doubt += rows.align[code] * lost
        seen = np.maximum(np.abs(met) - lost, 0)
        doubt += rows.left * np.sqrt(np.maximum(self._length**2 - seen**2, 0))
        doubt += SLACK * (1 + self._length * (rows.align.sum(axis=0) + rows.left))
        return total - doubt, total + doubt


def _first(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` by score downwards, then id; each id once."""
    order = np.lexsort((ids, -scores))
    if len(order) > n and len(np.unique(ids[order[:n]])) < n:
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
    return order[:n]


def _at_least(values: np.ndarray, n: int) -> float:
    """The n-th largest value, minus infinity if there are fewer."""
    return -np.inf if len(values) < n else float(np.partition(values, len(values) - n)[len(values) - n])


def _block_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), dtype=np.int64).reshape(len(ids), -1)
    return ids, labels, x


def best_of_label(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """For each anchor, the block's best rows of its label, other than itself."""
    ids, labels, x = _block_of(rows)
    codes_of_all = Coded.read(rows["codes"].to_pylist())
    out = {"anchor": [], "vec_id": [], "score": []}
    coded = {}
    for anchor, label, y in zip(*_block_of(anchors)):
        if label not in coded:
            own = np.flatnonzero(labels == label)
            coded[label] = own, codes_of_all.take(own)
        own, codes = coded[label]
        low, high = Asked(y).interval(codes)
        other = ids[own] != anchor
        maybe = own[other & (high >= _at_least(low[other], BEST))]
        scores = x[maybe] @ y
        for k in _first(scores, ids[maybe], BEST):
            out["anchor"].append(anchor)
            out["vec_id"].append(ids[maybe[k]])
            out["score"].append(scores[k])
    return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})


def best_below(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """For each anchor and positive, the block's best rows of other labels within its bounds."""
    ids, labels, x = _block_of(rows)
    codes = Coded.read(rows["codes"].to_pylist())
    out = {"anchor": [], "positive": [], "positive_score": [], "vec_id": [], "score": []}
    for (anchor, label, y), positives in zip(zip(*_block_of(anchors)), anchors["positives"].to_pylist()):
        low, high = Asked(y).interval(codes)
        other = labels != label
        wanted = np.zeros(len(ids), dtype=bool)
        for p in positives:
            top, bottom = p["score"], 0.8 * p["score"]
            # rows that surely qualify set the bar for all that may
            sure = other & (low >= bottom + 1e-6 * (1 + abs(bottom))) & (high <= top)
            bar = max(_at_least(low[sure], BEST), bottom - 1e-6 * (1 + abs(bottom)))
            wanted |= other & (high >= bar) & (low <= top)
        maybe = np.flatnonzero(wanted)
        scores = x[maybe] @ y
        for p in positives:
            top = p["score"]
            # 80 * top <= 100 * score, with numbers that stay small
            fit = np.flatnonzero((4 * top - 4 * scores <= scores) & (scores <= top))
            for k in fit[_first(scores[fit], ids[maybe[fit]], BEST)]:
                row = anchor, p["vec_id"], top, ids[maybe[k]], scores[k]
                for name, value in zip(out, row):
                    out[name].append(value)
    return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})


def _integers(values: pa.Scalar) -> np.ndarray | None:
    """The parts of a finite vector, scaled and rounded down; None for any other."""
    x = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(x) or not np.isfinite(x).all():
        return None
    x = np.floor(SCALE * x)
    return x.astype(np.int64) if np.abs(x).max() < np.sqrt(2**59 / len(x)) else None


def _taking_part(table: DataFrame) -> DataFrame:
    """``vec_id, label, width, x, codes``: rows with a label and a finite vector, its parts scaled to integers."""

    def rows(batches):
        for batch in batches:
            found = [_integers(values) for values in batch.column(2)]
            widths = np.array([-1 if x is None else len(x) for x in found], dtype=np.int32)
            for width in np.unique(widths[widths >= 0]):
                at = np.flatnonzero(widths == width)
                x = np.stack([found[i] for i in at])
                columns = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(widths[at])]
                columns += [pa.array([row.tobytes() for row in x], pa.binary()), pa.array(Coded.of(x).stored(), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "width", "x", "codes"])

    given = table.filter("label is not null and vec_id is not null and embedding is not null")
    # a missing part reads as not a number, which is not finite
    parts = F.transform("embedding", lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))
    df = given.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), parts.alias("embedding"))
    return df.mapInArrow(rows, "vec_id bigint, label bigint, width int, x binary, codes binary")


def _best(found: DataFrame, by: list[str]) -> DataFrame:
    """The first ``BEST`` of each group, with their rank; cut in each task before the shuffle."""
    found = found.groupBy(*by, "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= BEST)


def _grid(rows: DataFrame, anchors: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on each block of rows with each block of anchors of the same width."""
    n_blocks = max(LEAST_BLOCKS, -(-staged_metrics(rows)["rows"] // BLOCK))
    n_anchors = max(1, -(-staged_metrics(anchors)["rows"] // ANCHORS))
    place = lambda n, name: F.pmod(F.xxhash64("vec_id", F.lit(n)), F.lit(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = rows.select("*", place(n_blocks, "block")).select("*", every(n_anchors, "part"))
    right = anchors.select("*", place(n_anchors, "part")).select("*", every(n_blocks, "block"))
    keys = ["width", "block", "part"]

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            return work(a, b)
        return pa.table({name: pa.array([], pa.int64()) for name in schema.replace(" bigint", "").split(", ")})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, schema)


def _every_hundredth() -> Column:
    return F.col("vec_id") % 100 == 0


def hard_negatives(table: DataFrame, is_anchor: Column | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows ``vec_id, embedding, label`` without an id, a label or a vector, with an empty
    vector or with a part that is null or not finite, take no part. Parts become
    ``floor(256 * x)``; a score is an integer inner product. An anchor's positives are its
    first 5 other rows of the same label; the negatives of each are the first 5 rows of
    another label with a score between 0.8 and 1 times the positive's. First is the higher
    score, then the smaller id. Only vectors of one length meet. Rows that share an id count
    once, by the better score, and never as their own positive. Parts so large that a score
    could pass 59 bits are not supported: such rows take no part. Other columns of ``table``
    play no part. No anchors or no rows give no rows.
    """
    rows = staged(_taking_part(table), "integers")
    anchors = staged(rows.filter(_every_hundredth() if is_anchor is None else is_anchor), "anchors")
    near = _grid(rows, anchors, best_of_label, "anchor bigint, vec_id bigint, score bigint")
    near = _best(near, ["anchor"]).groupBy("anchor").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))
    asked = staged(anchors.join(staged(near, "positives").withColumnRenamed("anchor", "vec_id"), "vec_id"), "asked")
    names = "anchor bigint, positive bigint, positive_score bigint, vec_id bigint, score bigint"
    found = _best(_grid(rows, asked, best_below, names), ["anchor", "positive", "positive_score"])
    return found.select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def moved_labels(table: DataFrame) -> DataFrame:
    """Every seventh row under the next label, as wrongly labelled rows to mine against."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return table.select("vec_id", "embedding", moved.alias("label"))
