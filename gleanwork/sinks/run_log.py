"""Run log: the messages of a run as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_rows(runs: DataFrame, run_id: str, events: list[tuple[str, Column, Column]]) -> DataFrame:
    """``run_id, step, event, n`` from one row per run.

    ``events`` holds (event, whether it happened, its count) in time order; steps are
    numbered over the events that happened. One pass, no union of scans.
    """
    entries = F.filter(
        F.array(
            *[
                F.when(happened, F.struct(F.lit(name).alias("event"), n.cast("bigint").alias("n")))
                for name, happened, n in events
            ]
        ),
        lambda e: e.isNotNull(),
    )
    return (
        runs.select(F.col(run_id).alias("run_id"), F.posexplode(entries).alias("pos", "_e"))
        .select("run_id", (F.col("pos") + 1).alias("step"), "_e.event", "_e.n")
    )


def write_run_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)
