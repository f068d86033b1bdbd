"""Streamed sets: batches, order, repeats and restarts make no difference."""

import datetime as dt
import random

from pyspark.sql import functions as F

from gleanwork.session import fresh_path
from gleanwork.streaming.seen import Sightings, _stretches, seen_lately, seen_lately_batch, write_seen

SCHEMA = "kind string, item string, id string, at timestamp"
START = dt.datetime(2024, 5, 1)


def made(n, seed):
    rng = random.Random(seed)
    items = [("hot", "x")] * 3 + [("a", f"i{k}") for k in range(6)] + [(None, "only item"), ("b", None)]
    rows = []
    for number in range(n):
        kind, item = rng.choice(items)
        at = START + dt.timedelta(seconds=rng.randrange(40_000), microseconds=rng.randrange(3))
        rows.append((kind, item, f"m{number:04d}", at))
    return rows


def expected(rows, keep):
    out, last = [], {}
    for kind, item, number, at in sorted(set(rows), key=lambda r: (r[3], r[2])):
        if kind is None and item is None or at is None:
            continue
        key = kind, item
        if key not in last or at - last[key] > keep:
            out.append((kind, item, number, at))
        last[key] = at
    return sorted(out, key=repr)


def stream(spark, deliveries, keep, delay):
    folder, out, checkpoint = (fresh_path(spark, n) for n in ("in", "out", "offsets"))
    for rows in deliveries:
        spark.createDataFrame(rows, SCHEMA).coalesce(2).write.mode("append").parquet(folder)
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(folder)
        # a new query object for each delivery: a restart from the checkpoint
        write_seen(seen_lately(source, ["kind", "item"], "id", "at", keep, delay), out, checkpoint).awaitTermination()
    read = spark.read.schema("kind string, item string, first_id string, first_seen timestamp").parquet(out)
    return sorted(map(tuple, read.collect()), key=repr)


def test_stream_equals_batch(spark):
    rows = made(400, 1)
    keep = dt.timedelta(seconds=900)
    end = (None, None, "end", START + dt.timedelta(days=9))
    rng = random.Random(2)
    by_time = sorted(rows, key=lambda r: r[3] + dt.timedelta(seconds=rng.randrange(3000)))
    first, second = by_time[:250], by_time[250:] + rng.sample(by_time[:250], 60)
    rng.shuffle(second)
    want = expected(rows, keep)
    # the missing time and the missing item count for nothing
    first.append(("a", "i1", "no time", None))
    got = stream(spark, [first, [*second, end]], "900 seconds", "4 hours")
    assert got == want and len(want) < len(rows)
    batch = seen_lately_batch(spark.createDataFrame([*rows, *rows, ("a", "i1", "no time", None)], SCHEMA), ["kind", "item"], "id", "at", "900 seconds")
    assert sorted(map(tuple, batch.select("kind", "item", "first_id", "first_seen").collect()), key=repr) == want


def test_state_is_given_up(spark):
    """After the silence nothing is remembered: the same message counts again if time has gone on."""
    one = [("a", "x", "m1", START)]
    tick = lambda hours: (None, None, "t", START + dt.timedelta(hours=hours))
    later = [("a", "x", "m2", START + dt.timedelta(hours=20)), tick(40)]
    got = stream(spark, [[*one, tick(10)], later], "1 hour", "10 minutes")
    assert [r[2] for r in got] == ["m1", "m2"]


def test_a_task_sends_few_rows_of_a_hot_item():
    import pandas as pd

    rows = pd.DataFrame({"k": ["h"] * 1000, "start_us": range(1000), "end_us": range(1000), "first_id": [str(i) for i in range(1000)]})
    out = _stretches(rows, ["k"], 5)
    assert out.values.tolist() == [["h", 0, 999, "0"]]
    apart = rows.assign(start_us=rows["start_us"] * 10, end_us=rows["end_us"] * 10)
    assert len(_stretches(apart, ["k"], 5)) == 1000
    inside = pd.DataFrame({"k": ["h"] * 3, "start_us": [0, 10, 100], "end_us": [200, 20, 300], "first_id": list("abc")})
    assert _stretches(inside, ["k"], 5).values.tolist() == [["h", 0, 300, "a"]]


def test_an_item_sets_one_timer():
    import pandas as pd

    class Handle:
        def __init__(self):
            self.timers, self.rows = [], []

        def getListState(self, name, schema):
            return self

        def registerTimer(self, at):
            self.timers.append(at)

        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)
        put = lambda self, rows: setattr(self, "rows", rows)
        clear = lambda self: setattr(self, "rows", [])

    class Times:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    handle, item = Handle(), Sightings(["k"], 5_000)
    item.init(handle)
    times = [0, 100_000, 200_000]
    rows = pd.DataFrame({"start_us": times, "end_us": times, "first_id": ["a", "b", "c"]})
    list(item.handleInputRows(("x",), iter([rows]), Times(0)))
    assert handle.timers == [1]
    told = []
    for _ in range(9):
        if handle.timers:
            at = handle.timers.pop()
            told += [v for out in item.handleExpiredTimer(("x",), Times(at), None) for v in out["first_id"]]
    assert told == ["a", "b", "c"] and handle.rows == []
