"""Keyed file and page tables with repeatable writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gleanwork.operators.files import skip_existing
from gleanwork.operators.pages import keyed_pages
from gleanwork.operators.skew import rebalanced, without_known
from gleanwork.session import stage

# Folders of a keyed table. Hosts and repositories are too many for a folder each;
# a large table wants more from its first write on, so that a folder stays small enough to
# rewrite.
PARTS = 64


def part_of(group: Column | str, parts: int = PARTS) -> Column:
    """Folder number of a host or repository."""
    return F.pmod(F.xxhash64(group), F.lit(parts)).cast("int")


def _path_exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, None before its first write."""
    if not _path_exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        # the folder is there, but no file yet
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise


def layout(spark: SparkSession, path: str, parts: int | None = None) -> int:
    """Number of folders of the table at ``path``; ``parts`` counts for a table that is not there yet.

    It is kept with the table, as rows of one group would else come to lie in two folders.
    """
    place = f"{path}/_layout"
    spark.createDataFrame([(parts or PARTS,)], "parts int").write.mode("ignore").parquet(place)
    return spark.read.schema("parts int").parquet(place).first()["parts"]


def read_group(spark: SparkSession, path: str, group: str, value: str) -> DataFrame:
    """Rows of one host or repository; reads its folder only."""
    part = part_of(F.lit(value), layout(spark, path))
    return spark.read.parquet(path).filter((F.col("part") == part) & (F.col(group) == value))


def append(df: DataFrame, path: str, group: str, parts: int | None = None) -> None:
    parted = df.withColumn("part", part_of(group, layout(df.sparkSession, path, parts)))
    rebalanced(parted, "part").write.mode("append").partitionBy("part").parquet(path)


def _rewrite(new: DataFrame, path: str, group: str, keys: list[str], parts: int | None) -> None:
    """Put ``new`` in place of the stored rows with the same ``keys``.

    Only the folders of the groups at hand are read and rewritten.
    """
    spark = new.sparkSession
    old = read_table(spark, path)
    new = stage(new.withColumn("part", part_of(group, layout(spark, path, parts))), "new")
    merged = new
    if old is not None:
        # at most ``parts`` numbers; as constants they prune the scan of the old table
        touched = [row["part"] for row in new.select("part").distinct().collect()]
        kept = without_known(old.filter(F.col("part").isin(touched)), new.select(*keys).distinct(), keys)
        # staged: these rows come from the folders that are about to be replaced
        merged = stage(new.unionByName(kept), "merged")
    (
        rebalanced(merged, "part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("part")
        .parquet(path)
    )


def upsert(new: DataFrame, path: str, group: str, keys: list[str], parts: int | None = None) -> None:
    """Write rows unique on ``keys``; a second run with the same rows changes nothing."""
    _rewrite(new, path, group, keys, parts)


def replace_groups(new: DataFrame, path: str, group: str, parts: int | None = None) -> None:
    """Write whole groups: all stored rows of the same hosts or repositories go."""
    _rewrite(new, path, group, [group], parts)


def ingest_documents(ingested: DataFrame, path: str, group: str, parts: int | None = None) -> None:
    """Append every attempted file with its status."""
    append(ingested, path, group, parts)


def save_pages(pages: DataFrame, path: str, parity: bool = False, parts: int | None = None) -> None:
    """Store pages by (host, key); a later page under the same key replaces the earlier."""
    upsert(keyed_pages(pages, parity), path, "host", ["host", "key"], parts)


def write_if_absent(new: DataFrame, path: str, group: str, on: list[str], order: str, parts: int | None = None) -> None:
    """Append only rows whose key the table lacks."""
    fresh = skip_existing(new, read_table(new.sparkSession, path), on, order)
    append(fresh, path, group, parts)


def replace_repo(files: DataFrame, path: str, merge: bool = False, parts: int | None = None) -> None:
    """Store the files of repositories in place of their earlier copy.

    ``merge`` keeps stored files that the new copy lacks, as unpacking over an
    existing folder does.
    """
    if merge:
        upsert(files, path, "full_name", ["full_name", "path"], parts)
    else:
        replace_groups(files, path, "full_name", parts)
