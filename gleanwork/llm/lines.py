"""Removal of lines that repeat an earlier passage of three lines.

Windows of three consecutive lines are hashed, the first place of each hash is found over
all documents, and lines covered by any later place go. Blank lines are neither counted nor
removed, so a document needs three lines with words to lose one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.llm.common import packed, unpacked

WINDOW = 3


def _text() -> Column:
    return F.col("doc").getField("text")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with their document's key: the id and a hash of the text.

    Rows that agree in both are one document. Different texts under one id, or without an
    id, are told apart by the hash; documents without an id come last.
    """
    doc = F.col("doc")
    return packed(docs).select(
        "doc", doc.getField("doc_id").isNull().alias("no_id"), doc.getField("doc_id").alias("id"), F.xxhash64(_text()).alias("t")
    )


def _with_lines(df: DataFrame) -> DataFrame:
    """Add ``lines`` and ``at``, the places of lines that hold a word."""
    df = df.withColumn("lines", F.split(F.coalesce(_text(), F.lit("")), "\n"))
    worded = F.filter(
        F.transform("lines", lambda x, i: F.when(x.rlike("[^\\x20\\x09-\\x0D]"), i)), lambda i: i.isNotNull()
    )
    return df.withColumn("at", worded)


def windows(df: DataFrame) -> DataFrame:
    """``no_id, id, t, j, a, b``: each window's number and two hashes of its lines."""
    df = _with_lines(df)
    line = lambda i: F.get(F.col("lines"), i)
    df = df.withColumn("ha", F.transform("at", lambda i: F.xxhash64(line(i))))
    df = df.withColumn("hb", F.transform("at", lambda i: F.xxhash64(F.lit("second"), line(i))))
    three = lambda name, j: [F.get(F.col(name), j + k) for k in range(WINDOW)]
    row = lambda j: F.struct(
        j.alias("j"), F.xxhash64(*three("ha", j)).alias("a"), F.xxhash64(*three("hb", j)).alias("b")
    )
    df = df.filter(F.size("at") >= WINDOW)
    all_of = F.transform(F.sequence(F.lit(0), F.size("at") - WINDOW), row)
    return df.select("no_id", "id", "t", F.explode(all_of).alias("w")).select("no_id", "id", "t", "w.*")


def later_windows(df: DataFrame) -> DataFrame:
    """``id, t, later``: the numbers of the windows whose lines occur at an earlier place.

    The first place is a minimum, combined before the shuffle, and the join back is a plain
    one that adaptive execution splits for a passage in a third of all documents. The
    collected numbers are those of one document.
    """
    found = windows(df)
    place = F.struct("no_id", "id", "t", "j")
    first = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1").drop("n")
    later = found.join(first, ["a", "b"]).filter(place > F.col("first"))
    return later.groupBy("id", "t").agg(F.collect_set("j").alias("later"))


def marked(docs: DataFrame) -> DataFrame:
    """``doc, n_lines, n_removed, kept``: lines with words, how many go, and the text left.

    A null text has no lines and stays null. Rows are kept, also those with nothing left.
    """
    keyed = _keyed(docs)
    later = later_windows(keyed).select(F.col("id").alias("_id"), F.col("t").alias("_t"), "later")
    df = keyed.join(later, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
    df = _with_lines(df)
    covered = F.flatten(
        F.transform("later", lambda j: F.array(*[F.get(F.col("at"), j + k) for k in range(WINDOW)]))
    )
    df = df.withColumn("gone", F.array_distinct(covered))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    return df.select(
        "doc",
        F.size("at").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.when(F.col("gone").isNull(), _text()).otherwise(text).alias("kept"),
    )


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with their text cut, in the columns given; ``n_chars`` follows the text.

    A document that loses all its lines goes; one that had none stays.
    """
    df = marked(docs).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        n = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(changed, n).otherwise(F.col("doc").getField("n_chars"))
    return unpacked(df, docs.columns, **new)
