"""The stored name index against a plain search, and what a lookup reads."""

import random

from pyspark.sql import functions as F

from gleanwork.operators import name_index
from gleanwork.operators.name_index import NameIndex
from gleanwork.session import fresh_path

NAMES = "id long, name string"


def searched(names, terms):
    return sorted({(q, i) for q in terms if q is not None for i, name in names if q.lower() in name.lower()})


def test_names_come_and_go(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abÄ/-") for _ in range(rng.randrange(1, 9)))
    there = set()
    index = NameIndex(spark, fresh_path(spark, "index"), parts=7)
    frame = lambda rows: spark.createDataFrame(list(rows), NAMES)
    for step in range(3):
        added = {(rng.randrange(40), word()) for _ in range(40)} | set(rng.sample(sorted(there), min(5, len(there))))
        removed = set(rng.sample(sorted(there), len(there) // 3)) | {(99, "never there")}
        index.update(frame([*added, *added, (None, "x"), (1, None)]), frame(removed))
        there = (there - removed) | added
        terms = [word() for _ in range(12)] + [rng.choice(sorted(there))[1][1:5] for _ in range(8)] + ["", "a", "zzzz", "ab/-ab/-ab", None]
        got = sorted(map(tuple, index.lookup(spark.createDataFrame([(t,) for t in terms], "q string")).collect()))
        assert got == searched(there, terms), step
        if step == 1:
            index.compact()
            assert sorted(map(tuple, index.names().collect())) == sorted(there)


def test_hot_pieces_are_split(spark):
    rows = [(i, f"own{i}/widget-{i % 7}") for i in range(300)]
    index = NameIndex(spark, fresh_path(spark, "index"), parts=5)
    index.update(spark.createDataFrame(rows, NAMES))
    terms = ["widget", "widget-3", "own1", "get-", "t"]
    got = sorted(map(tuple, index.lookup(spark.createDataFrame([(t,) for t in terms], "q string"), rows_per_task=20).collect()))
    assert got == searched(rows, terms)


def test_empty_index_and_broken_run(spark):
    path = fresh_path(spark, "index")
    index = NameIndex(spark, path)
    terms = spark.createDataFrame([("ab",), ("",)], "q string")
    assert index.lookup(terms).count() == 0
    spark.createDataFrame([(5, "abba", 1)], "id long, name string, sign int").write.parquet(f"{path}/names/run=1")
    index.update(spark.createDataFrame([(1, "xaby")], NAMES))
    assert sorted(map(tuple, index.lookup(terms).collect())) == [("", 1), ("ab", 1)]


def test_a_lookup_reads_only_the_folders_of_its_pieces(spark):
    rows = [(i, f"name{i:04d}") for i in range(2000)]
    index = NameIndex(spark, fresh_path(spark, "index"), parts=64)
    index.update(spark.createDataFrame(rows, NAMES))
    pieces = spark.createDataFrame([("1234",), ("e123",)], "piece string")
    read = index._read("postings", pieces)
    folders = {r[0] for r in read.select(F.regexp_extract(F.input_file_name(), "part=([0-9]+)", 1)).distinct().collect()}
    touched = {str(r[0]) for r in pieces.select(index._part("piece")).collect()}
    assert folders <= touched and len(touched) <= 2
    plan = read._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("\n")[0]
    assert "part#" in filters and "run#" in filters
    assert [r.id for r in index.lookup(spark.createDataFrame([("ame1234",)], "q string")).collect()] == [1234]


def test_a_long_term_is_looked_up_by_one_piece(spark, monkeypatch):
    wanted, stage = [], name_index.stage

    def seen(df, label, **metrics):
        out = stage(df, label, **metrics)
        if label == "wanted_pieces":
            wanted.extend(row["q"] for row in out.collect())
        return out

    monkeypatch.setattr(name_index, "stage", seen)
    index = name_index.NameIndex(spark, fresh_path(spark, "index"))
    index.update(added=spark.createDataFrame([(1, "one/Red-bolt"), (2, "two/red-bolts"), (3, "red")], "id bigint, name string"))
    terms = spark.createDataFrame([("red-bolt",), ("zzzzz",)], "q string")
    assert sorted(map(tuple, index.lookup(terms).collect())) == [("red-bolt", 1), ("red-bolt", 2)]
    assert wanted == ["red-bolt"]
