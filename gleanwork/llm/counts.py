"""Token counts as rollups kept up to date by signed changes.

A batch of changes (documents that come, go, or are counted anew) is summed to one signed
row per source, language and tokenizer version, and committed once under the batch's name.
Totals are sums over all committed batches; folding many batches into one keeps them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.llm.common import staged, words
from gleanwork.llm.tokens import Tokens, default_path
from gleanwork.session import staged_metrics
from gleanwork.sinks.runs import Runs, State

KEYS = ["source", "lang", "version"]


def counter(tokenizer: str | None = None):
    """A column function: the number of a text's token ids, 0 for null."""
    path = tokenizer or default_path()

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        tokens = Tokens(path)
        return pd.Series([len(tokens.of(text or "")) for text in texts], dtype="int64")

    return count


def n_words(text):
    return F.size(words(text)).cast("bigint")


def inserted(counts: DataFrame) -> DataFrame:
    """Changes for new rows ``source, lang, version, tokens``."""
    return counts.select(*KEYS, F.lit(1).cast("bigint").alias("d_docs"), F.col("tokens").alias("d_tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Changes for rows that go, with the count they came with."""
    return counts.select(*KEYS, F.lit(-1).cast("bigint").alias("d_docs"), (-F.col("tokens")).alias("d_tokens"))


def revised(counts: DataFrame) -> DataFrame:
    """Changes for rows ``source, lang, version, tokens, new_tokens`` that are counted anew."""
    return counts.select(*KEYS, F.lit(0).cast("bigint").alias("d_docs"), (F.col("new_tokens") - F.col("tokens")).alias("d_tokens"))


class Rollup:
    """Committed batches below ``path``, a folder that all executors share.

    A batch is a run: its sums and its name are written first, its commit last. What a run
    that broke off has left is passed over, and written again by the next one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._runs = spark, Runs(spark, path, ["sums", "batches"])

    def _names(self, state: State) -> DataFrame:
        return self._runs.stored("batches", state)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch's sums; False, and nothing done, if it is committed already with the same sums.

        The same name with other sums is an error, as one of the two would be lost. Sums are
        combined before the shuffle, so a source with a third of all rows is no burden. Null
        sources and languages are values of their own. Rows whose sums are zero stay out.
        """
        sums = changes.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        sums = staged(sums.filter("d_docs <> 0 or d_tokens <> 0"), "sums", digest=F.sum(F.xxhash64(*KEYS, "d_docs", "d_tokens").cast("decimal(38,0)")))
        digest = str(staged_metrics(sums)["digest"] or 0)
        state = self._runs.state()
        if state.tables:
            known = self._names(state).filter(F.col("batch") == batch).first()
            if known is not None:
                if known["digest"] != digest:
                    raise ValueError(f"batch {batch!r} is committed with other sums")
                return False
        self._write(sums, self._spark.createDataFrame([(batch, digest)], "batch string, digest string"), state)
        return True

    def _write(self, sums: DataFrame, names: DataFrame, state: State, base: int | None = None) -> None:
        run = state.number + 1
        self._runs.put(sums, "sums", run)
        self._runs.put(names, "batches", run)
        self._runs.commit(State(run, base or state.base, {"sums", "batches"}))

    def fold(self) -> None:
        """Put one run in place of all: the totals so far, and the names of their batches."""
        state = self._runs.state()
        if state.tables:
            sums = self.totals().withColumnsRenamed({"n_docs": "d_docs", "n_tokens": "d_tokens"})
            self._write(sums, staged(self._names(state), "names"), state, state.number + 1)

    def totals(self) -> DataFrame:
        """``source, lang, version, n_docs, n_tokens`` of what has come and not gone."""
        state = self._runs.state()
        if not state.tables:
            return self._spark.createDataFrame([], "source string, lang string, version string, n_docs bigint, n_tokens bigint")
        sums = self._runs.stored("sums", state).groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")


def corpus_totals(docs: DataFrame, path: str, tokenizer: str | None = None) -> DataFrame:
    """Totals after a corpus has come, was recounted, and lost its repeated texts.

    Batch 1 brings every row with its words, under both versions; batch 2 counts the second
    version anew with the tokenizer; batch 3 takes away, from both, the rows whose text and
    source occur under a smaller id. Batch 2 is sent twice and counts once; then all are folded.
    A null text has no tokens; rows without id, and null texts, are never taken away. No rows
    give no totals.
    """
    text = F.col("text")
    counted = docs.select("doc_id", "source", "lang", F.xxhash64("text", F.lit(1)).alias("a"), F.xxhash64("text", F.lit(2)).alias("b"), text.isNotNull().alias("given"), n_words(text).alias("words"), counter(tokenizer)("text").alias("ids"))
    counted = staged(counted, "counted")
    versions = F.explode(F.array(F.lit("words"), F.lit("byte_bpe_50k")))
    first = counted.select("source", "lang", versions.alias("version"), F.col("words").alias("tokens"))
    second = counted.select("source", "lang", F.lit("byte_bpe_50k").alias("version"), F.col("words").alias("tokens"), F.col("ids").alias("new_tokens"))
    least = counted.filter("given and doc_id is not null").groupBy("a", "b", F.col("source").alias("_source")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    least = staged(least.filter("n > 1").drop("n"), "repeated")
    gone = counted.join(least, ["a", "b"]).filter(F.col("source").eqNullSafe(F.col("_source")) & (F.col("doc_id") > F.col("first_id")))
    count = F.when(F.col("version") == "words", F.col("words")).otherwise(F.col("ids"))
    third = gone.select("source", "lang", versions.alias("version"), "words", "ids").select(*KEYS, count.alias("tokens"))
    rollup = Rollup(docs.sparkSession, path)
    rollup.commit("1", inserted(first))
    for _ in range(2):
        rollup.commit("2", revised(second))
    rollup.commit("3", deleted(third))
    rollup.fold()
    return rollup.totals()
