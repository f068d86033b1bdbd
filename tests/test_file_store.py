"""The store that keeps each content once."""

import os

from pyspark.sql import functions as F

from gleanwork.sinks.file_store import FileStore

SCHEMA = "full_name string, path string, content binary"


def files_of(folder):
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, names in os.walk(folder) for f in names}


def rows_of(store):
    return sorted(((r.full_name, r.path, r.content and bytes(r.content)) for r in store.read().collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_one_file_in_many_repositories(spark, tmp_path):
    store = FileStore(spark, str(tmp_path), 4)
    shared = [(f"o/r{i}", "LICENSE", b"same") for i in range(100)]
    own = [(f"o/r{i}", "README", b"own %d" % i) for i in range(5)]
    store.write(table(spark, shared + own))
    assert store.contents().count() == 6
    assert rows_of(store) == sorted(shared + own, key=str)


def test_a_write_leaves_earlier_folders_alone(spark, tmp_path):
    store = FileStore(spark, str(tmp_path), 4)
    first = [("a/a", "x", b"1"), ("a/a", "y", b"2"), ("b/b", "x", b"1"), ("b/b", "gone", b"3")]
    store.write(table(spark, first))
    before = files_of(tmp_path)
    store.write(table(spark, [("b/b", "x", b"4"), ("b/b", "new", b"1")]))
    store.write(table(spark, [("a/a", "y", b"5")]), merge=True)
    after = files_of(tmp_path)
    assert {name: after.get(name) for name in before} == before
    expected = [("a/a", "x", b"1"), ("a/a", "y", b"5"), ("b/b", "new", b"1"), ("b/b", "x", b"4")]
    assert rows_of(store) == expected
    store.compact()
    assert rows_of(store) == expected
    assert store.contents().count() == 5
    store.sweep()
    assert rows_of(store) == expected
    assert sorted(bytes(r.content) for r in store.contents().collect()) == [b"1", b"4", b"5"]
    # what was swept can come back, and a store opened again goes on with its own folders
    again = FileStore(spark, str(tmp_path), 16)
    again.write(table(spark, [("c/c", "z", b"2")]))
    assert rows_of(again) == [*expected, ("c/c", "z", b"2")]


def test_the_same_write_again_stores_no_content(spark, tmp_path):
    store = FileStore(spark, str(tmp_path), 4)
    new = table(spark, [("a/a", str(i), b"%d" % (i % 3)) for i in range(20)])
    store.write(new)
    before, rows = files_of(tmp_path / "blobs"), rows_of(store)
    store.write(new)
    assert files_of(tmp_path / "blobs") == before and rows_of(store) == rows


def test_missing_and_repeated_values(spark, tmp_path):
    store = FileStore(spark, str(tmp_path), 4)
    assert store.read().count() == 0 and store.contents().count() == 0
    store.compact()
    store.sweep()
    store.write(table(spark, []))
    assert store.read().count() == 0
    odd = [(None, "p", b"1"), (None, None, None), ("a/a", None, b""), ("a/a", "p", None), ("a/a", "p", b"2"), ("a/a", "p", b"2")]
    store.write(table(spark, odd))
    expected = sorted({(None, "p", b"1"), (None, None, None), ("a/a", None, b""), ("a/a", "p", b"2")}, key=str)
    assert sorted(rows_of(store), key=str) == expected
    store.write(table(spark, [(None, "q", b"3")]))
    assert sorted(rows_of(store), key=str) == sorted({(None, "q", b"3"), *[r for r in expected if r[0]]}, key=str)


def test_a_run_that_broke_off_does_not_count(spark, tmp_path):
    store = FileStore(spark, str(tmp_path), 4)
    store.write(table(spark, [("a/a", "x", b"1")]))
    lost = store._files.state().number + 1
    store._files.put(spark.createDataFrame([("a/a", "lost", None, lost)], "full_name string, path string, digest string, version int"), "files", lost)
    assert rows_of(store) == [("a/a", "x", b"1")]
    store.write(table(spark, [("b/b", "y", b"2")]))
    assert rows_of(store) == [("a/a", "x", b"1"), ("b/b", "y", b"2")]


def test_reads_only_the_folders_of_its_digests(spark, tmp_path):
    store = FileStore(spark, str(tmp_path), 64)
    store.write(table(spark, [("a/a", str(i), b"%d" % i) for i in range(200)]))
    part = store.contents().filter("digest = sha2('7', 256)").first()["part"]
    plan = store.contents().filter(F.col("part").isin([part])).select("digest")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "content" not in plan.split("ReadSchema")[1].split("\n")[0]
