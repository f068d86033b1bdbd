"""Mixing sources to target weights by whole and fractional repetition.

Words are summed per source, a water level gives each source its target, and a document is
taken floor(rate) times plus once more with the fraction's probability. The draw is a hash
of a seed and the document's id, so reruns and retried tasks agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.llm.common import packed, staged, unpacked, words

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # the mix has 3/2 of all words
AT_MOST = 2  # times a source's own words
SEED = "mix-1"
_DRAWS = float(16**13)


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``; a null source is one too.

    Sources in order of size per weight reach their limit first. One is at its limit if the
    water level, with all before it at theirs, stands above it; the rest share what is left
    by weight. Whole numbers up to the last division, so the order of rows cannot matter.
    The windows run over one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    places = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(w).cast("bigint") for w in weights])
    by = by.withColumn("weight", F.get(given, ((F.row_number().over(places) - 1) % len(weights)).cast("int")))
    up, down = SHARE
    every = Window.partitionBy()
    level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    onward = level.rowsBetween(0, Window.unboundedFollowing)
    limit = F.col("source_size") * AT_MOST
    by = by.withColumn("limit", limit)
    by = by.withColumn("all_left", F.sum("source_size").over(every) * up - F.coalesce(F.sum("limit").over(before), F.lit(0)) * down)
    over = F.col("all_left").cast("double") * F.col("weight") > F.col("limit").cast("double") * down * F.sum("weight").over(onward)
    by = by.withColumn("full", over)
    rest = F.sum("source_size").over(every) * up - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(F.lit(0))).over(every) * down
    shared = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight"))).over(every) * down
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(
        (F.col("weight") * rest).cast("double") / shared.cast("double")
    )
    return by.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1 that depends on the seed and the id alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(_DRAWS)


def with_copies(df: DataFrame, by_source: DataFrame) -> DataFrame:
    """Add ``source_size, target, copies`` to rows with ``doc_id`` and ``source``.

    ``by_source`` has one row per source, written before, so Spark knows its size and
    broadcasts it only below its own threshold.
    """
    theirs = by_source.withColumnRenamed("source", "_source")
    df = df.join(theirs, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    more = (draw(F.col("doc_id")) < rate - F.floor(rate)).cast("bigint")
    return df.withColumn("copies", F.floor(rate) + more)


def shares(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row; a null text has size 0.

    Rows with the same id share one draw. No rows give no rows.
    """
    sizes = staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    df = with_copies(sizes, staged(targets(sizes), "targets"))
    return df.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, in the columns given."""
    sizes = docs.select("source", n_words(F.col("text")).alias("size"))
    by_source = staged(targets(sizes), "targets")
    df = packed(docs).select("doc", "doc.doc_id", "doc.source")
    df = with_copies(df, by_source)
    df = df.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"))
    return unpacked(df, docs.columns)
