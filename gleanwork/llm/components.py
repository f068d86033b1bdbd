"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.llm.common import staged
from gleanwork.session import staged_metrics


def _label(df: DataFrame, name: str) -> DataFrame:
    return staged(df, name, digest=F.bit_xor(F.xxhash64("v", "c")))


def components(edges: DataFrame) -> DataFrame:
    """``v, c`` for every vertex in ``edges(a, b)``: c is the smallest vertex it can reach.

    ``edges`` should be a written table. A round gives each vertex the smallest label among
    its neighbours, then the label of that label, and writes the labels. Minima are combined
    before the shuffle; links are joined to a written table, so adaptive execution can split
    a vertex with very many links. Ends when a round changes nothing. No links give no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    labels = _label(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("c")), "labels")
    while staged_metrics(labels)["rows"]:
        before = staged_metrics(labels)["digest"]
        heard = both.join(labels.withColumnRenamed("v", "a"), "a").select(F.col("b").alias("v"), "c")
        told = heard.union(labels).groupBy("v").agg(F.min("c").alias("c"))
        theirs = labels.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        labels = _label(told.join(theirs, "c").select("v", F.col("cc").alias("c")), "labels")
        if staged_metrics(labels)["digest"] == before:
            break
    return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels ``v, c`` after further ``links(a, b)``.

    Links are taken between the components that there are, so the rounds run over these and
    not over all earlier links again. A vertex without a label is its own.
    """
    for side in ("a", "b"):
        links = links.join(labels.select(F.col("v").alias(side), F.col("c").alias(f"c_{side}")), side, "left")
    ends = staged(links.select("a", "b", F.coalesce("c_a", "a").alias("c_a"), F.coalesce("c_b", "b").alias("c_b")), "ends")
    between = staged(ends.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).filter("a <> b").distinct(), "between")
    moved = components(between).select(F.col("v").alias("c"), F.col("c").alias("to"))
    new = ends.select(F.col("a").alias("v"), F.col("c_a").alias("c")).union(ends.select("b", "c_b"))
    every = labels.select("v", "c").union(new.join(labels, "v", "left_anti").distinct())
    return staged(every.join(moved, "c", "left").select("v", F.coalesce("to", "c").alias("c")), "labels")
