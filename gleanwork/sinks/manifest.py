"""Manifests: the addresses found per host, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.operators.skew import number_rows, without_known
from gleanwork.session import stage
from gleanwork.sinks.tables import layout, part_of, read_table, replace_groups


def manifest_lines(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """``host, is_page, line``: the seed line of each host, then its distinct pages."""
    first = seeds.select("host", F.lit(False).alias("is_page"), F.col("url").alias("line"))
    pages = found.select("host", F.lit(True).alias("is_page"), F.col("url").alias("line"))
    return first.unionByName(pages).distinct()


def write_manifest(found: DataFrame, seeds: DataFrame, path: str) -> None:
    """One folder of text per host: seed line first, then pages in sorted order.

    Folders of other hosts stay as they are. For many hosts see ``merge_manifest``.
    Lines are sorted by range, so a big host gives several files whose names follow
    the order; reading them by name gives the sorted manifest.
    """
    (
        manifest_lines(found, seeds)
        .repartitionByRange("host", "is_page", "line")
        .sortWithinPartitions("host", "is_page", "line")
        .select("host", F.col("line").alias("value"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("host")
        .text(path)
    )


def merge_manifest(found: DataFrame, seeds: DataFrame, path: str, parts: int | None = None) -> None:
    """Add pages to the manifests of their hosts: a table of ``host, is_page, line, line_no``.

    Lines of the hosts at hand are merged with those that are stored and numbered anew, seed
    line first, then pages in order; a new seed takes the place of the old one. Folders are
    by hash of the host, and hosts that share one with a changed host are copied, others are
    not touched. Runs in any number give the lines of one run over everything.
    """
    new = stage(manifest_lines(found, seeds), "lines")
    old = read_table(new.sparkSession, path)
    lines = new
    if old is not None:
        part = part_of("host", layout(new.sparkSession, path))
        hosts = stage(new.select("host", part.alias("part")).distinct(), "hosts")
        # at most as many numbers as the table has folders
        touched = [row["part"] for row in hosts.select("part").distinct().collect()]
        stored = old.filter(F.col("part").isin(touched)).join(hosts.select("host"), "host", "left_semi")
        seeded = new.filter("not is_page").select("host").distinct().withColumn("is_page", F.lit(False))
        lines = new.unionByName(without_known(stored, seeded, ["host", "is_page"]).select("host", "is_page", "line")).distinct()
    replace_groups(number_rows(lines, ["host"], ["is_page", "line"], "line_no"), path, "host", parts)
