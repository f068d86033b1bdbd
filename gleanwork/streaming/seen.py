"""A set that grows with a stream and forgets what has not been seen for a while.

An item that comes again within ``keep`` of its last sighting is a repeat; after a longer
silence it counts as new. Each item's state is the stretches of time in which it was seen,
merged as messages arrive in any order, and a stretch is dropped ``keep`` after its end. So
the state holds what was seen lately, not the whole history.

A stretch is reported once no earlier message can come any more, that is when the watermark
has passed its start. What a stream reports therefore does not depend on how its messages
were cut into batches, on their order within ``delay``, on repeats, or on restarts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Python state needs this store; the default one keeps all state in the JVM's memory.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Stretches that a task holds back to merge them with those of later batches.
HELD_ROWS = 50_000

_STRETCH = "start_us bigint, end_us bigint, first_id string"


def _micros(span: str) -> int:
    return pd.Timedelta(span) // pd.Timedelta(1, "us")


def _stretches(rows: pd.DataFrame, by: list[str], keep_us: int) -> pd.DataFrame:
    """Stretches of rows ``by, start_us, end_us, first_id``, merged where the silence between them is at most ``keep_us``.

    Ends run up to the highest so far, as a stretch may lie inside an earlier one.
    """
    rows = rows.sort_values([*by, "start_us", "first_id"], kind="stable")
    reach = rows.groupby(by, sort=False, dropna=False)["end_us"].cummax() if by else rows["end_us"].cummax()
    before = reach.groupby([rows[c] for c in by], sort=False, dropna=False).shift() if by else reach.shift()
    number = (before.isna() | (rows["start_us"] - before > keep_us)).cumsum()
    merged = rows.groupby(number, sort=False)
    out = merged.first() if by else merged[["start_us", "first_id"]].first()
    out["end_us"] = merged["end_us"].max()
    return out[[*by, "start_us", "end_us", "first_id"]].reset_index(drop=True)


class Sightings(StatefulProcessor):
    """Stretches of one item; reports the first message of each, then forgets it in time."""

    def __init__(self, keys: list[str], keep_us: int):
        self._keys, self._keep = keys, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getListState("stretches", f"{_STRETCH}, told boolean")

    def _read(self) -> list[tuple]:
        return [tuple(row) for row in self._state.get()] if self._state.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, now = self._read(), 1000 * timerValues.getCurrentWatermarkInMs()
        for part in rows:
            # what ended before the watermark is late, and may be a repeat of something forgotten
            part = part[part["end_us"] >= now]
            known += [(int(a), int(b), c, False) for a, b, c in zip(part["start_us"], part["end_us"], part["first_id"])]
        if not known:
            return
        merged: list[list] = []
        for start, end, first, told in sorted(known):
            if merged and start - merged[-1][1] <= self._keep:
                merged[-1][1] = max(merged[-1][1], end)
                merged[-1][3] = merged[-1][3] or told
            else:
                merged.append([start, end, first, told])
        self._state.put([tuple(s) for s in merged])
        self._wake(merged)
        yield from ()

    def _wake(self, stretches: list) -> None:
        """One timer, for what is due next; when it goes off it sets the one after."""
        self._handle.registerTimer(min(end + self._keep if told else start for start, end, _, told in stretches) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, due, stay = 1000 * timerValues.getCurrentWatermarkInMs(), [], []
        for start, end, first, told in self._read():
            if not told and start < now:
                due.append((start, first))
                told = True
            if end + self._keep >= now:
                stay.append((start, end, first, told))
        if stay:
            self._state.put(stay)
            self._wake(stay)
        else:
            self._state.clear()
        if due:
            out = {name: [value] * len(due) for name, value in zip(self._keys, key)}
            yield pd.DataFrame({**out, "first_us": [d[0] for d in due], "first_id": [d[1] for d in due]})


def seen_lately(items: DataFrame, keys: list[str], item_id: str, time: str, keep: str, delay: str) -> DataFrame:
    """Stream of ``keys, first_id, first_seen``: the first message of each stretch of an item.

    ``items`` is a stream with a timestamp ``time``; keys are strings and may be null.
    ``keep`` and ``delay`` are texts like ``1 hour``. Rows without a time are left out.
    Messages of one time are told apart by the smaller id. Each task merges the rows of an
    item before the shuffle, over batches too, so an item with a third of all messages sends
    a few stretches per task. Rows that come more than ``delay`` late are dropped unless a timely one of
    their stretch travels with them.
    """
    spark = items.sparkSession
    spark.conf.set(STATE_STORE, ROCKSDB)
    keep_us = _micros(keep)
    at = F.unix_micros("_at")
    rows = items.select(*keys, F.col(item_id).cast("string").alias("first_id"), F.col(time).cast("timestamp").alias("_at"))
    rows = rows.withWatermark("_at", delay).select(*keys, at.alias("start_us"), at.alias("end_us"), "first_id")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            # a filter in the plan would sink below the watermark, which rows without a key move on as well
            held.append(_stretches(batch[batch["start_us"].notna() & batch[keys].notna().any(axis=1)], keys, keep_us))
            size += len(held[-1])
            if size > HELD_ROWS:
                held = [_stretches(pd.concat(held), keys, keep_us)]
                size = len(held[0])
                # where merging saves little, rows go on
                if size > HELD_ROWS // 2:
                    yield held[0]
                    held, size = [], 0
        if held:
            yield _stretches(pd.concat(held), keys, keep_us)

    kinds = ", ".join(f"{k} string" for k in keys)
    few = rows.mapInPandas(merge, f"{kinds}, {_STRETCH}")
    told = few.groupBy(*keys).transformWithStateInPandas(
        Sightings(keys, keep_us),
        outputStructType=f"{kinds}, first_us bigint, first_id string",
        outputMode="Append",
        timeMode="EventTime",
    )
    return told.select(*keys, "first_id", F.timestamp_micros("first_us").alias("first_seen"))


def seen_lately_batch(items: DataFrame, keys: list[str], item_id: str, time: str, keep: str) -> DataFrame:
    """What ``seen_lately`` reports, for items that are all at hand.

    The silence before a message is the time since the one before it of the same item.
    """
    at = F.col(time).cast("timestamp")
    rows = items.filter(F.col(time).isNotNull() & F.coalesce(*keys).isNotNull())
    rows = rows.select(*keys, F.col(item_id).cast("string").alias("first_id"), at.alias("first_seen"))
    # one row per time first, so that a hot item is cut down before the shuffle
    rows = rows.groupBy(*keys, "first_seen").agg(F.min("first_id").alias("first_id"))
    now = F.unix_micros("first_seen")
    silence = now - F.lag(now).over(Window.partitionBy(*keys).orderBy("first_seen"))
    rows = rows.withColumn("_silence", silence).filter(F.col("_silence").isNull() | (F.col("_silence") > _micros(keep)))
    return rows.select(*keys, "first_id", "first_seen")


def write_seen(seen: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append reports to ``out`` until all input at hand is read; go on from there when started again."""
    return (
        seen.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .format("parquet")
        .start(out)
    )
