"""Branch choice and ingestion of files with a fallback address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions.urls import raw_file_url, relative_dir
from gleanwork.model import BRANCH_CANDIDATES
from gleanwork.operators.skew import ROWS_PER_TASK, first_per_group, key_load, split_join, without_known


def first_branch(branches: DataFrame) -> DataFrame:
    """First candidate branch that each repository has; NULL when it has none."""
    position = F.array_position(F.lit(BRANCH_CANDIDATES), F.col("branch"))
    best = F.min(F.when(position > 0, position))
    return branches.groupBy("full_name").agg(
        F.when(best.isNotNull(), F.element_at(F.lit(BRANCH_CANDIDATES), best.cast("int"))).alias("branch")
    )


def raw_urls(files: DataFrame, name: str, branch: Column | str, parity: bool = False) -> DataFrame:
    """``files(root, dir, file)`` with the folder below root and the raw address."""
    return files.withColumn("relpath", relative_dir("dir", "root")).withColumn(
        "raw_url", raw_file_url(name, branch, "relpath", "file", parity)
    )


def ingest_with_fallback(
    files: DataFrame,
    raw_available: DataFrame,
    fallback: bool = True,
    spread: list[str] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Status of each file of ``files(supported, raw_url)``: local, raw or failed.

    Only unsupported files are looked up among the raw addresses that exist.
    """
    supported = F.coalesce(F.col("supported"), F.lit(False))
    local = files.filter(supported).withColumn("status", F.lit("local"))
    rest = files.filter(~supported)
    if not fallback:
        return local.unionByName(rest.withColumn("status", F.lit("failed")))
    known = raw_available.select("raw_url").distinct().withColumn("_known", F.lit(True))
    load = key_load(rest, ["raw_url"], rows_per_task)
    looked_up = (
        split_join(rest, known, ["raw_url"], spread or ["dir", "file"], load, "left")
        .withColumn("status", F.when(F.col("_known"), "raw").otherwise("failed"))
        .drop("_known")
    )
    return local.unionByName(looked_up)


def attempt_count(ingested: DataFrame, by: list[str]) -> DataFrame:
    """Files attempted, failures included, with the count per status."""
    def with_status(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return ingested.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempted"),
        with_status("local").alias("local"),
        with_status("raw").alias("raw"),
        with_status("failed").alias("failed"),
    )


def skip_existing(new: DataFrame, existing: DataFrame | None, on: list[str], order: str) -> DataFrame:
    """New rows whose key is not there yet; of equal new keys the first one stays, of equal rows one.

    Rows without a key count as one key.
    """
    fresh = first_per_group(new, on, order)
    return fresh if existing is None else without_known(fresh, existing, on)
