"""A stored index for searches of a term inside names.

A name is cut into pieces of ``GRAM`` characters, one from each place; those at its end are
shorter. So a term of ``GRAM`` characters or more lies in a name only if all its pieces do,
and a shorter one only if some piece begins with it. The index keeps postings (piece, id) in
folders by a hash of the piece, and the number of names per piece. Names that come and go
are signed rows of a new run; a lookup adds them up.

A lookup takes the rarest piece of each term, reads the folders of these pieces alone, and
tests the names in their postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.operators.skew import ROWS_PER_TASK, key_load, rebalanced, split_join
from gleanwork.session import stage, staged_metrics
from gleanwork.sinks.runs import Runs, State

GRAM = 4
PARTS = 64


def _grams(text: Column) -> Column:
    """Distinct pieces from every place of a text, none for the empty one."""
    length = F.char_length(text)
    places = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, GRAM)))


def _full_grams(text: Column) -> Column:
    """Distinct pieces of full length of a text that has one."""
    places = F.sequence(F.lit(1), F.char_length(text) - (GRAM - 1))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, GRAM)))


class NameIndex:
    """Names ``id, name`` below ``path``; search ignores case. An id may have several names."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self._spark, self._runs = spark, Runs(spark, path, ["names", "postings", "pieces"])
        self._parts = parts

    def _part(self, piece: Column | str) -> Column:
        return F.pmod(F.xxhash64(piece), F.lit(self._parts)).cast("int")

    def _put(self, names: DataFrame, base: bool = False) -> None:
        """Write signed names with their postings and piece counts as a run, the first that counts if ``base``."""
        last = self._runs.state()
        run = last.number + 1
        names = self._runs.put(names, "names", run)
        cut = names.select("id", "name", "sign", F.explode(_grams(F.lower("name"))).alias("piece"))
        # two names of one id that share a piece are two postings
        postings = cut.groupBy("piece", "id").agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0")
        postings = postings.withColumn("part", self._part("piece"))
        # by piece inside the files, so that a reader skips most of a folder too
        self._runs.put(rebalanced(postings, "part").sortWithinPartitions("part", "piece", "id"), "postings", run, ["part"])
        counts = self._runs.of_run("postings", run).groupBy("part", "piece").agg(F.sum("sign").cast("bigint").alias("n"))
        self._runs.put(rebalanced(counts, "part").sortWithinPartitions("part", "piece"), "pieces", run, ["part"])
        self._runs.commit(State(run, run if base else last.base, {"names", "postings", "pieces"}))

    def update(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Take in names ``added(id, name)`` and drop ``removed(id, name)``.

        A name that is there already is not added again, one that is not there is not
        dropped; a name in both stays. Missing ids and names are left out.
        """
        none = self._spark.createDataFrame([], "id bigint, name string")
        rows = lambda df: (none if df is None else df.select(F.col("id").cast("bigint"), "name")).filter("id is not null and name is not null").distinct()
        plus, minus, keys = rows(added), rows(removed), ["id", "name"]
        minus = minus.join(plus, keys, "left_anti")
        if self._runs.state().number:
            known = self.names()
            plus, minus = plus.join(known, keys, "left_anti"), minus.join(known, keys, "left_semi")
        else:
            minus = none
        signed = plus.withColumn("sign", F.lit(1)).unionByName(minus.withColumn("sign", F.lit(-1)))
        self._put(signed)

    def names(self) -> DataFrame:
        """``id, name`` of all names that are there."""
        rows = self._runs.stored("names", self._runs.state())
        return rows.groupBy("id", "name").agg(F.sum("sign").alias("n")).filter("n > 0").select("id", "name")

    def compact(self) -> None:
        """Write what is there as one run, with which reading starts; earlier folders stay for running readers."""
        if self._runs.state().number:
            self._put(self.names().withColumn("sign", F.lit(1)), base=True)

    def _read(self, name: str, pieces: DataFrame) -> DataFrame:
        """Rows of the folders that ``pieces`` touch; their numbers, at most ``parts``, prune the scan."""
        touched = [row["part"] for row in pieces.select(self._part("piece").alias("part")).distinct().collect()]
        return self._runs.stored(name, self._runs.state()).filter(F.col("part").isin(touched))

    def _term_pieces(self, terms: DataFrame) -> DataFrame:
        """Staged ``q, t, piece, n``: the rarest piece of longer terms, all that a shorter one begins."""
        long = terms.filter(F.char_length("t") >= GRAM).select("q", "t", F.explode(_full_grams(F.col("t"))).alias("piece"))
        long = stage(long, "term_pieces")
        counts = self._read("pieces", long).groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 0")
        by_rarity = Window.partitionBy("q").orderBy("n", "piece")
        # a piece that no name has rules its term out
        known = split_join(long, counts, ["piece"], ["q"], key_load(long, ["piece"]), "left")
        ranked = known.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("_place", F.row_number().over(by_rarity))
        chosen = ranked.filter(F.col("_place") == 1).drop("_place")
        short = terms.filter((F.char_length("t") < GRAM) & (F.col("t") != ""))
        every = self._runs.stored("pieces", self._runs.state()).groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 0")
        starts = every.select("piece", "n", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.char_length("piece"), F.lit(GRAM - 1))), lambda i: F.substring("piece", 1, i))).alias("t"))
        begun = starts.join(short, "t").select("q", "t", "piece", "n")
        return stage(chosen.unionByName(begun), "chosen_pieces")

    def lookup(self, terms: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
        """``q, id`` for every distinct term of ``terms(q)`` contained in a name of an id, case ignored.

        The empty term is in every name. A null term finds nothing.
        """
        terms = stage(terms.select("q", F.lower("q").alias("t")).filter("q is not null").distinct(), "terms", empty=F.count_if(F.col("q") == ""))
        if not self._runs.state().number:
            return self._spark.createDataFrame([], "q string, id bigint")
        pieces = self._term_pieces(terms)
        # the rarest piece of a longer term, any that a shorter one begins; a piece that no name has rules its term out
        wanted = stage(pieces.filter("n > 0").select("q", "t", "piece"), "wanted_pieces")
        postings = self._read("postings", wanted).join(wanted.select("piece").distinct(), "piece", "left_semi")
        here = postings.groupBy("piece", "id").agg(F.sum("sign").alias("sign")).filter("sign > 0").select("piece", "id")
        names = self.names()
        # names go with their postings, so that a candidate is tested where it arises and never moved
        named = stage(here.join(names, "id").select("piece", "id", F.lower("name").alias("name")), "postings")
        # a common piece of many terms is heavy on both sides
        load = key_load(wanted, ["piece"], rows_per_task)
        heavy = key_load(named, ["piece"], rows_per_task)
        met = split_join(wanted, named, ["piece"], ["q"], load, right_spread=["id"], right_load=heavy)
        found = met.filter(F.contains("name", F.col("t"))).select("q", "id").distinct()
        if not staged_metrics(terms)["empty"]:
            return found
        return found.unionByName(names.select(F.lit("").alias("q"), "id").distinct())
