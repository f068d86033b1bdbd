"""Words, column names and written tables shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.session import stage

# Words are runs of anything but these six characters; bytes.split() has the same rule.
SPACES = "[\\x20\\x09-\\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def col(name: str) -> Column:
    """A column whose name may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def words(text: Column) -> Column:
    """All words of a text, unchanged and in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def staged(df: DataFrame, label: str, **metrics: Column) -> DataFrame:
    """``stage`` that also drops the shuffle files of the write once it is done.

    What follows reads the written table, so those files have no use any more.
    """
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        return stage(df, label, **metrics)
    finally:
        spark.conf.set(_CLEANUP, before)


def packed(docs: DataFrame) -> DataFrame:
    """Rows as one column ``doc``, so that names of any extra columns cannot clash."""
    return docs.select(F.struct(*[col(name) for name in docs.columns]).alias("doc"))


def unpacked(df: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The columns of ``packed`` again, with those in ``new`` put in place of theirs."""
    doc = F.col("doc")
    return df.select(*[new.get(name, doc.getField(name)).alias(name) for name in names])
