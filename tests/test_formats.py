"""Archives and folders as data sources."""

import hashlib
import io
import os
import random
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from gleanwork.session import fresh_path
from gleanwork.sources.formats import Found, listed, register_formats, shares
from gleanwork.sources.storage import list_files


def packed(entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in entries:
            archive.writestr(name, data)
    return buffer.getvalue()


def save(folder, name, data):
    path = os.path.join(str(folder), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(data)
    return path


def contents(df):
    """Entries put together from their pieces."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.path, r.entry or "", r.piece or 0)):
        key = os.path.basename(r.path), r.entry
        data, n, problem = out.get(key, (b"", r.n, None))
        out[key] = data + bytes(r.content or b""), r.n, problem or r.problem
    return out


@pytest.fixture(scope="module")
def formats(spark):
    register_formats(spark)
    return spark


def test_one_large_archive_goes_to_many_tasks(formats, tmp_path):
    rng = random.Random(1)
    files = [(f"src/f{i}.bin", rng.randbytes(3000)) for i in range(400)]
    save(tmp_path, "own/rep.zip", packed(files))
    df = formats.read.format("archives").option("path", str(tmp_path)).option("partitionBytes", 100_000).load()
    tasks = df.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= 10 and max(r["count"] for r in tasks) < 60
    assert contents(df) == {("rep.zip", name): (data, 3000, None) for name, data in files}


def test_small_archives_share_a_task(formats, tmp_path):
    for i in range(30):
        save(tmp_path, f"own/rep{i}.zip", packed([("a.txt", b"x" * i)]))
    df = formats.read.format("archives").option("path", str(tmp_path)).option("partitionBytes", 16 << 20).load()
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() < 10
    assert contents(df) == {(f"rep{i}.zip", "a.txt"): (b"x" * i, i, None) for i in range(30)}


def test_awkward_archives(formats, tmp_path):
    good = packed([("d/", b""), ("a.txt", b"draft"), ("../a.txt", b"final"), ("empty", b""), ("big", b"0123456789" * 100)])
    save(tmp_path, "good.zip", good)
    save(tmp_path, "zero.zip", b"")
    save(tmp_path, "text.zip", b"no archive at all " * 50)
    save(tmp_path, "none.zip", packed([]))
    stored = io.BytesIO()
    with zipfile.ZipFile(stored, "w") as archive:
        archive.writestr("broken", b"some content here")
        archive.writestr("fine", b"fine")
    broken = stored.getvalue().replace(b"some content", b"SOME content", 1)
    save(tmp_path, "broken.zip", broken)
    df = formats.read.format("archives").option("path", str(tmp_path)).option("pieceBytes", 64).load()
    got = contents(df)
    assert got[("good.zip", "a.txt")] == (b"final", 5, None)
    assert got[("good.zip", "empty")] == (b"", 0, None)
    assert got[("good.zip", "big")] == (b"0123456789" * 100, 1000, None)
    assert df.filter("entry = 'big'").count() == 16
    assert got[("zero.zip", None)][2] == got[("text.zip", None)][2] == "bad_archive"
    assert got[("broken.zip", "broken")][2] == "bad_entry" and got[("broken.zip", "fine")] == (b"fine", 4, None)
    assert not [k for k in got if k[0] == "none.zip"] and len(got) == 7


def test_folders_and_links(formats, tmp_path):
    save(tmp_path, "a/_hidden", b"h")
    save(tmp_path, "a/b/.dot", b"")
    save(tmp_path, "a/b/long", b"z" * 1000)
    os.symlink(tmp_path, tmp_path / "a" / "loop")
    os.symlink(tmp_path / "a" / "_hidden", tmp_path / "a" / "same")
    df = formats.read.format("folders").option("path", str(tmp_path)).option("pieceBytes", 300).load()
    assert contents(df) == {("_hidden", "_hidden"): (b"h", 1, None), (".dot", ".dot"): (b"", 0, None), ("long", "long"): (b"z" * 1000, 1000, None), ("same", "same"): (b"h", 1, None)}
    walked = {(r.file, r.length) for r in list_files(formats, str(tmp_path)).collect()}
    assert walked == {("_hidden", 1), (".dot", 0), ("long", 1000), ("same", 1)}
    with pytest.raises(Exception, match="path option"):
        formats.read.format("folders").load().count()


def test_stream_goes_on_after_a_restart(formats, tmp_path):
    out, checkpoint = fresh_path(formats, "unpacked"), fresh_path(formats, "offsets")
    want = {}
    for part in range(3):
        for i in range(4):
            data = f"{part} {i}".encode() * 50
            save(tmp_path, f"in/own{i}/rep{part}.zip", packed([("x", data)]))
            want[(f"rep{part}.zip", hashlib.sha256(data).hexdigest())] = 1
        stream = formats.readStream.format("archives").option("path", str(tmp_path / "in")).load()
        query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
        query.awaitTermination()
        assert formats.read.parquet(out).count() == len(want)
    got = formats.read.parquet(out).select(F.element_at(F.split("path", "/"), -1).alias("p"), F.sha2("content", 256).alias("d"))
    assert {tuple(r) for r in got.collect()} == set(want)


def test_shares():
    files = [Found("a", 250, 0), Found("b", 0, 0), Found("c", 90, 0)]
    assert [s.ranges for s in shares(files, 100, True)] == [[("a", 0, 100)], [("a", 100, 200)], [("a", 200, 250)], [("b", 0, 0)], [("c", 0, 90)]]
    assert shares([], 100, True) == []
    covered = [r for s in shares(files, 64, False) for r in s.ranges]
    assert covered == [("a", 0, 250), ("b", 0, 0), ("c", 0, 90)]


def test_very_many_files_take_little_room_in_the_driver():
    n = 300_000
    files = (Found(f"/shared/archives/own{i % 10}/rep{i}.zip", i % 5_000, 0) for i in range(n))
    tracemalloc.start()
    made = shares(files, 128 << 20, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * n and len(made) <= 2_000
    assert [r for s in made for r in s.ranges] == [(f"/shared/archives/own{i % 10}/rep{i}.zip", 0, i % 5_000) for i in range(n)]
    large = shares((Found(str(i), 100, 0) for i in range(5_000)), 100, True)
    assert [s.ranges for s in large] == [[(str(i), 0, 100)] for i in range(5_000)]


def test_a_folder_is_listed_in_slices(tmp_path):
    for i in range(50):
        save(tmp_path, f"own{i % 3}/rep{i}.zip", b"x" * i)
    (tmp_path / "own1" / "other").write_bytes(b"")
    files = listed(str(tmp_path), ".zip")
    assert iter(files) is files
    assert sorted((f.path, f.length) for f in files) == sorted((str(tmp_path / f"own{i % 3}" / f"rep{i}.zip"), i) for i in range(50))


def test_an_empty_folder_has_no_rows(formats, tmp_path):
    for kind in ("archives", "folders"):
        df = formats.read.format(kind).option("path", str(tmp_path)).load()
        assert df.columns == ["path", "entry", "n", "piece", "content", "problem"] and df.collect() == []


def test_requests_whose_archives_are_all_missing(spark, tmp_path):
    """Every repository has a row of a small size, which makes its archive a missing one."""
    from checks.queries import QUERIES

    tables = {
        "part": ("p_partkey int, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(i, f"part {i}", "Brand#1", "PROMO", 1, 1.0) for i in range(12)]),
        "customer": ("c_custkey int, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(i, "c", 20 + i // 6, 5000.0, "BUILDING") for i in range(12)]),
        "region": ("r_regionkey int, r_name string", [(0, "r")]),
        "pages": ("page_id long, url string, html string", [(i, f"https://a.org/{i}", "") for i in range(12)]),
        "conversations": ("conv_id long, turn int, role string, text string", [(i, 0, "user", "t") for i in range(12)]),
        "documents": ("doc_id long, text string, lang string, source string, n_chars long", [(i, f"text {i}", "en", "web", 1000) for i in range(12)]),
        "labels": ("doc_id long, quality int, toxic int", [(0, 1, 0)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    status = QUERIES["get_code_answered_status"](spark, str(tmp_path))
    found = {r.req_id: (r.fetch_mode, r.status, r.attempted) for r in status.collect()}
    assert found == {"0-0": ("zip", "missing_archive", 0), "1-0": ("zip", "list", 0), "2-0": ("zip", "not_found", 0), "6-0": ("api", "download", 1), "7-0": ("api", "list", 0), "8-0": ("api", "not_found", 0)}
    ingested = QUERIES["get_code_ingested"](spark, str(tmp_path))
    assert [(r.full_name, r.fetch_mode, r.status) for r in ingested.collect()] == [("brand1/part-6", "api", "local")]
