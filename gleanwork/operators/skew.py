"""Joins and numbering that hold when one key has a third of all rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.session import stage, staged_metrics

# A key with more rows than this is spread over several tasks.
ROWS_PER_TASK = 1_000_000
# A table of narrow rows is broadcast up to this many of them.
BROADCAST_ROWS = 100_000


@dataclass
class KeyLoad:
    """The keys of a table that have more than ``rows_per_task`` rows; None if no key has."""

    on: list[str]
    heavy: DataFrame | None
    rows_per_task: int

    def splits(self) -> DataFrame | None:
        """Number of splits per key to spread, None when no key is that heavy."""
        if self.heavy is None:
            return None
        return self.heavy.select(*self.on, F.ceil(F.col("_n") / self.rows_per_task).cast("int").alias("_splits"))


def key_counts(df: DataFrame, on: list[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))


def load_of(counts: DataFrame, on: list[str], rows_per_task: int = ROWS_PER_TASK) -> KeyLoad:
    """Write the heavy keys of exact ``counts(on, _n)``, however many there are.

    A table has at most one such key per ``rows_per_task`` rows. Mostly no key is heavy
    and the joins that follow stay plain.
    """
    heavy = stage(counts.select(*on, "_n").filter(F.col("_n") > rows_per_task), "heavy_keys")
    return KeyLoad(on, heavy if staged_metrics(heavy)["rows"] else None, rows_per_task)


def key_load(
    df: DataFrame, on: list[str], rows_per_task: int = ROWS_PER_TASK, at_most: int | None = None
) -> KeyLoad:
    """Heavy keys of ``df``.

    No job is needed when the whole table, by ``at_most`` or as staged, has no more
    rows than one task takes.
    """
    if at_most is None and staged_metrics(df) is not None:
        at_most = staged_metrics(df)["rows"]
    if at_most is not None and at_most <= rows_per_task:
        return KeyLoad(on, None, rows_per_task)
    return load_of(key_counts(df, on), on, rows_per_task)


def _spread(df: DataFrame, on: list[str], by: list[str], splits: DataFrame | None, name: str) -> DataFrame:
    """Give each row of a heavy key one split number by a hash of the ``by`` columns."""
    if splits is None:
        return df
    number = F.pmod(F.xxhash64(*by), F.coalesce("_splits", F.lit(1))).cast("int")
    return df.join(splits, on, "left").withColumn(name, number).drop("_splits")


def _repeat(df: DataFrame, on: list[str], splits: DataFrame | None, name: str) -> DataFrame:
    """Repeat each row of a heavy key once per split number."""
    if splits is None:
        return df
    numbers = F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1)
    return df.join(splits, on, "left").withColumn(name, F.explode(numbers)).drop("_splits")


def split_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread: list[str],
    load: KeyLoad,
    how: str = "inner",
    right_spread: list[str] | None = None,
    right_load: KeyLoad | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Equi-join in which the rows of a heavy key go to several tasks.

    Left rows are spread by a hash of the ``spread`` columns; the right rows of the
    same key are repeated once per split, so the result is that of the plain join.
    Works for inner, left, left_semi and left_anti. For keys heavy on both sides an
    inner join takes ``right_load`` too and cuts the key into a grid. The heavy keys are
    a written table, which Spark broadcasts only if its size allows.

    ``tasks`` is for a join with many more rows than its inputs: it keeps this many tasks,
    which adaptive execution would merge by the size of the inputs, and takes the left rows
    in turn, so that rows that repeat a left row follow each other.
    """
    if right_load is not None and how != "inner":
        raise ValueError("both sides can be spread in an inner join only")
    keys = list(on)
    by_left = load.splits()
    by_right = right_load.splits() if right_load is not None else None
    left = _repeat(_spread(left, on, spread, by_left, "_split"), on, by_right, "_cut")
    right = _spread(_repeat(right, on, by_left, "_split"), on, right_spread or on, by_right, "_cut")
    if by_left is not None:
        keys.append("_split")
    if by_right is not None:
        keys.append("_cut")
    if tasks is not None:
        left, right = left.repartition(tasks, *keys).hint("merge"), right.repartition(tasks, *keys)
    return left.join(right, keys, how).drop("_split", "_cut")


def join_counted(
    left: DataFrame,
    right: DataFrame,
    n_right: int,
    on: list[str],
    spread: list[str],
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join to a right side of known size: broadcast up to ``BROADCAST_ROWS``, else split.

    The left side is looked through for heavy keys only in the second case.
    """
    if n_right <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    return split_join(left, right, on, spread, key_load(left, on, rows_per_task), how)


def join_present(
    left: DataFrame, right: DataFrame, on: list[str], spread: list[str], load: KeyLoad | None = None
) -> DataFrame:
    """Left join that keeps rows without a key out of the shuffle.

    A plain left join sends all rows with a NULL key to one task. Here they pass by
    and get NULL for the right columns.
    """
    has_key = F.lit(True)
    for name in on:
        has_key = has_key & F.col(name).isNotNull()
    present = left.filter(has_key)
    if load is None:
        joined = present.join(right, on, "left")
    else:
        joined = split_join(present, right, on, spread, load, "left")
    return joined.unionByName(left.filter(~has_key), allowMissingColumns=True)


def number_rows(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """``row_number`` per group without bringing a group together in one task.

    Rows are sorted by range over all tasks, so a big group spans several of them.
    A row's number is its place inside the task plus the group's rows in earlier
    tasks, which come from one small count per group and task.
    """
    ordered = stage(
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_row", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn("_task", F.shiftright("_row", 33))
    pieces = ordered.groupBy(*group, "_task").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    # names of their own, as both sides come from the same table
    theirs = {name: f"_{i}" for i, name in enumerate([*group, "_task"])}
    offsets = pieces.select(
        *[F.col(name).alias(other) for name, other in theirs.items()],
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    same = F.lit(True)
    for name, other in theirs.items():
        same = same & F.col(name).eqNullSafe(F.col(other))
    return ordered.join(offsets, same).select(
        *df.columns, (F.col("_row") - F.col("_first") + F.col("_before") + 1).alias(out)
    )


def _one_per_group(df: DataFrame, group: list[str], order: Column) -> DataFrame:
    """The row of each group that comes first; of equal orders the smaller row digest, of equal rows one.

    Spark cuts each task's rows to one per group before the shuffle, so a hot group costs no
    more than a row per task. Rows without a group are a group.
    """
    digest = F.xxhash64(*[F.col(c) for c, kind in df.dtypes if "map<" not in kind])
    place = F.row_number().over(Window.partitionBy(*group).orderBy(order, digest))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def first_per_group(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """The first row of each group by an order column; rows without an order come last."""
    return _one_per_group(df, group, F.col(order).asc_nulls_last())


def last_per_group(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """The last row of each group, like ``first_per_group``."""
    return _one_per_group(df, group, F.col(order).desc_nulls_last())


def without_known(new: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``known``; a missing key is a value like any other."""
    theirs = {name: f"_known_{i}" for i, name in enumerate(on)}
    keys = known.select(*[F.col(name).alias(other) for name, other in theirs.items()])
    same = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(other)) for name, other in theirs.items()])
    return new.join(keys, same, "left_anti")


def rebalanced(df: DataFrame, *cols: Column | str) -> DataFrame:
    """Even output files by ``cols``; adaptive execution splits the hot ones."""
    return df.hint("rebalance", *cols)
