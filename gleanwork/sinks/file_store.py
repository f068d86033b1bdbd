"""Files of repositories, each content kept once, with versions that are only ever added.

``contents`` has every distinct content under its digest, in folders by digest. ``files``
says which digest a path has had since a run, ``copies`` since which run a repository's
files count: a repository fetched anew starts over, and what its new copy lacks is gone.
A write adds folders and leaves all earlier ones as they are. A content that is there
already is read for its digest and not stored again, whichever repository brings it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.operators.skew import join_present, key_load, rebalanced
from gleanwork.session import stage, staged_metrics
from gleanwork.sinks.runs import Runs, State
from gleanwork.sinks.tables import PARTS, layout, part_of

FILE = "full_name string, path string, digest string, version int"


class FileStore:
    """Files ``full_name, path, content`` below ``path``, written by one job at a time.

    A missing content is stored as such, a missing repository or path is a value like any
    other. Of several rows for one path the one with the smallest digest counts, those
    without content last.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self._spark = spark
        self._contents = Runs(spark, f"{path}/blobs", ["contents"])
        self._files = Runs(spark, f"{path}/trees", ["files", "copies"])
        self._parts = layout(spark, path, parts)

    def _stored(self, runs: Runs, name: str, schema: str) -> DataFrame:
        state = runs.state()
        return runs.stored(name, state) if name in state.tables else self._spark.createDataFrame([], schema)

    def _part(self, digest: Column | str) -> Column:
        return part_of(digest, self._parts)

    def contents(self) -> DataFrame:
        """``digest, content, part``, one row per content."""
        return self._stored(self._contents, "contents", "digest string, content binary, part int")

    def write(self, new: DataFrame, merge: bool = False) -> None:
        """Take in whole repositories; with ``merge`` files that the new copy lacks stay.

        A run that broke off leaves contents that no file names, which the next one uses.
        """
        hashed = new.select("full_name", "path", "content", F.sha2("content", 256).alias("digest"))
        files = stage(hashed.groupBy("full_name", "path").agg(F.min("digest").alias("digest")), "files")
        self._add_contents(hashed, files)
        last = self._files.state()
        run = last.number + 1
        copies = self._spark.createDataFrame([], "full_name string, version int")
        if not merge:
            copies = files.select("full_name", F.lit(run).alias("version")).distinct()
        self._put_files(last, files.withColumn("version", F.lit(run)), copies, last.base)

    def _add_contents(self, hashed: DataFrame, files: DataFrame) -> None:
        digests = files.filter("digest is not null").select("digest").distinct().withColumn("part", self._part("digest"))
        digests = stage(digests, "digests")
        # at most ``parts`` numbers; they prune the folders that are looked through
        touched = [row["part"] for row in digests.select("part").distinct().collect()]
        known = self.contents().filter(F.col("part").isin(touched)).select("digest")
        missing = stage(digests.join(known, "digest", "left_anti"), "missing")
        if not staged_metrics(missing)["rows"]:
            return
        # one content per digest and task is moved, however many files have it
        once = hashed.filter("digest is not null").groupBy("digest").agg(F.any_value("content").alias("content"))
        last = self._contents.state()
        added = once.join(missing, "digest").select("digest", "content", "part")
        self._contents.put(rebalanced(added, "part").sortWithinPartitions("part", "digest"), "contents", last.number + 1, ["part"])
        self._contents.commit(State(last.number + 1, last.base, {"contents"}))

    def _put_files(self, last: State, files: DataFrame, copies: DataFrame, base: int) -> None:
        run = last.number + 1
        files = files.select("full_name", "path", "digest", "version")
        self._files.put(files, "files", run)
        self._files.put(copies, "copies", run)
        self._files.commit(State(run, base, {"files", "copies"}))

    def files(self) -> DataFrame:
        """``full_name, path, digest, version`` of the files that count."""
        rows = self._stored(self._files, "files", FILE)
        copies = self._stored(self._files, "copies", "full_name string, version int")
        since = copies.groupBy(F.col("full_name").alias("_name")).agg(F.max("version").alias("_since"))
        latest = rows.groupBy("full_name", "path").agg(F.max_by("digest", "version").alias("digest"), F.max("version").alias("version"))
        counted = latest.join(since, F.col("full_name").eqNullSafe(F.col("_name")), "left")
        return counted.filter(F.col("version") >= F.coalesce("_since", F.lit(0))).select("full_name", "path", "digest", "version")

    def read(self) -> DataFrame:
        """``full_name, path, digest, version, content`` of the files that count."""
        files = stage(self.files(), "files")
        # a content that very many files share is spread over tasks
        load = key_load(files.filter("digest is not null"), ["digest"], at_most=staged_metrics(files)["rows"])
        return join_present(files, self.contents().select("digest", "content"), ["digest"], ["full_name", "path"], load)

    def compact(self) -> None:
        """Write the files that count as one run, with which reading starts; no content is touched.

        Earlier folders stay for running readers.
        """
        last = self._files.state()
        if last.number:
            copies = self._spark.createDataFrame([], "full_name string, version int")
            self._put_files(last, stage(self.files(), "compacted"), copies, last.number + 1)

    def sweep(self) -> None:
        """Write the contents that some file still names as one run, with which reading starts."""
        last = self._contents.state()
        if last.number:
            used = stage(self.files().filter("digest is not null").select("digest").distinct(), "used")
            left = self.contents().join(used, "digest", "left_semi").select("digest", "content", "part")
            run = last.number + 1
            self._contents.put(rebalanced(left, "part").sortWithinPartitions("part", "digest"), "contents", run, ["part"])
            self._contents.commit(State(run, run, {"contents"} if staged_metrics(used)["rows"] else set()))
