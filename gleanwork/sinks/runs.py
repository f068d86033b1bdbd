"""Tables that grow by runs: one folder per run and table, and a commit that makes a run count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class State:
    """Number of a run, the first run that still counts, and the tables that have been written."""

    number: int
    base: int
    tables: set[str]


class Runs:
    """Tables below ``path``, a folder that all executors reach.

    A run writes its folders first and its commit last. A run that broke off has no commit;
    its folders are passed over by readers and written again under the same number.
    """

    def __init__(self, spark: SparkSession, path: str, tables: list[str]):
        self.spark, self.path, self._names = spark, path.rstrip("/"), tables
        self._schema = ", ".join(["number int", "base int", *(f"{name} boolean" for name in tables)])
        # run 0 has nothing; it is there so that later reads find a table
        self._row(State(0, 1, set())).write.mode("ignore").parquet(f"{self.path}/commits/run=0")

    def _row(self, state: State) -> DataFrame:
        return self.spark.createDataFrame([(state.number, state.base, *(name in state.tables for name in self._names))], self._schema)

    def state(self) -> State:
        """The last run that was committed, number 0 before the first."""
        commits = self.spark.read.schema(self._schema).parquet(f"{self.path}/commits")
        row = commits.agg(F.max_by(F.struct("*"), "number").alias("last")).first()["last"]
        return State(row["number"], row["base"], {name for name in self._names if row[name]})

    def commit(self, state: State) -> None:
        self.put(self._row(state), "commits", state.number)

    def stored(self, name: str, state: State) -> DataFrame:
        """Rows of a table that the runs up to a state have added, from its base on."""
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        return rows.filter((F.col("run") <= state.number) & (F.col("run") >= state.base)).drop("run")

    def of_run(self, name: str, run: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/run={run}")

    def put(self, df: DataFrame, name: str, run: int, by: list[str] | None = None) -> DataFrame:
        """Write a run's rows of a table, in folders by the columns ``by``; the rows as read back."""
        path = f"{self.path}/{name}/run={run}"
        df.write.mode("overwrite").partitionBy(*(by or [])).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
