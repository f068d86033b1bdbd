"""Files in and out: archives, trees, payload shapes, repeatable writes, streams."""

import glob
import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanwork.session import fresh_path, shared_dir
from gleanwork.sinks import manifest, run_log, tables
from gleanwork.sources import archives, search, storage, trees
from gleanwork.streaming import requests as streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: [(v is None, str(v)) for v in r])


def test_raw_payload_shapes(spark):
    shapes = [
        ('{"payload":{"results":[{"hl_name":"<em>a</em>&#x2F;b"},{"hl_name":"c/d"}]}}', "ok", 2),
        ('{"payload":{"results":[]}}', "ok", 0),
        ('{"payload":{}}', "bad_payload", 0),
        ('{"payload":{"results":[{"hl_name":"a/b"},{"name":"c"}]}}', "bad_payload", 0),
        ("not json", "bad_payload", 0),
        ("", "empty", 0),
        (None, "empty", 0),
    ]
    table = spark.createDataFrame([(i, js) for i, (js, _, _) in enumerate(shapes)], "i int, js string")
    status = {r["i"]: r["s"] for r in table.select("i", search.payload_status("js", "raw").alias("s")).collect()}
    assert [status[i] for i in range(len(shapes))] == [s for _, s, _ in shapes]
    got = search.read_search_raw(table, ["i"])
    assert rows(got) == [(0, 0, "a/b", "https://github.com/a/b"), (0, 1, "c/d", "https://github.com/c/d")]


def test_api_payload_shapes(spark):
    table = spark.createDataFrame(
        [(0, '{"items":[{"full_name":"a/b","html_url":"u"}]}'), (1, '{"items":[{"full_name":"a/b"}]}'), (2, '{"message":"x"}')],
        "i int, js string",
    )
    assert rows(search.read_search_api(table, ["i"])) == [(0, 0, "a/b", "u")]
    assert [r["s"] for r in table.orderBy("i").select(search.payload_status("js", "api").alias("s")).collect()] == ["ok", "bad_payload", "bad_payload"]


def zip_bytes(*entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in entries:
            archive.writestr(name, text)
    return buffer.getvalue()


def test_read_archives(spark, tmp_path):
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "rep.zip").write_bytes(
        zip_bytes(("rep-main/", ""), ("rep-main/a.txt", "one"), ("rep-main/a.txt", "two"), ("../../evil.txt", "x"), ("rep-main/d/e.txt", ""))
    )
    (tmp_path / "own" / "broken.zip").write_bytes(b"PK not a zip")
    (tmp_path / "own" / "note.txt").write_text("no archive")
    got = {r["path"]: (r["full_name"], r["content"] and bytes(r["content"]), r["problem"]) for r in archives.read_archives(spark, str(tmp_path), "/out").collect()}
    assert got == {
        "/out/own/rep/rep-main/a.txt": ("own/rep", b"two", None),
        "/out/own/rep/evil.txt": ("own/rep", b"x", None),
        "/out/own/rep/rep-main/d/e.txt": ("own/rep", b"", None),
        "/out/own/broken": ("own/broken", None, "bad_archive"),
    }
    assert trees.read_repositories(spark, "zip", "/out", folder=str(tmp_path)).count() == 3


def test_big_archive_is_cut_into_chunks(spark, tmp_path, monkeypatch):
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / ".github.zip").write_bytes(zip_bytes(*[(f"m/{i}.txt", "x" * 1000) for i in range(50)]))
    monkeypatch.setattr(archives, "CHUNK_BYTES", 4000)
    members = list(archives._list_members([pd.DataFrame({"path": [str(tmp_path / "own" / ".github.zip")]})]))
    assert members[0]["chunk"].nunique() == 13
    monkeypatch.setattr(archives, "BATCH_BYTES", 4000)
    parts = list(archives._read_members(members))
    assert len(parts) > 5 and sum(len(p) for p in parts) == 50
    got = archives.read_archives(spark, str(tmp_path), "/out")
    assert got.filter("n = 1000 and full_name = 'own/.github'").count() == 50


def test_bad_and_good_archives_in_one_batch(tmp_path):
    (tmp_path / "a.zip").write_bytes(b"no")
    (tmp_path / "b.zip").write_bytes(zip_bytes(("x.txt", "x")))
    listed = archives._list_members([pd.DataFrame({"path": [str(tmp_path / n) for n in ("a.zip", "b.zip")]})])
    together = pd.concat([m.astype({"member": "float64"}) for m in listed])
    (got,) = archives._read_members([together])
    assert list(got["problem"]) == ["bad_archive", None] and list(got["content"]) == [None, b"x"]


def test_missing_archive(spark):
    table = spark.createDataFrame([(1, None)], "i int, content binary")
    assert [(r["i"], r["problem"]) for r in archives.unzip(table, ["i"]).collect()] == [(1, "missing_archive")]


@pytest.mark.parametrize("per_task", [1, 1_000_000])
def test_list_tree(spark, per_task, monkeypatch):
    if per_task == 1:
        monkeypatch.setattr("gleanwork.operators.skew.BROADCAST_ROWS", 0)
    entries = [
        ("o/r", "1", None, "README", "file"),
        ("o/r", "2", None, "src", "dir"),
        ("o/r", "3", "2", "a.py", "file"),
        ("o/r", "4", "2", "deep", "dir"),
        ("o/r", "5", "4", "b.py", "file"),
        ("o/r", "6", "2", "link", "symlink"),
        ("o/r", "7", None, "empty", "dir"),
        ("o/s", "2", None, "lib", "dir"),
        ("o/s", "3", "2", "a.py", "file"),
        ("o/s", "9", "8", "lost.py", "file"),
    ]
    table = spark.createDataFrame(entries, "full_name string, id string, parent string, name string, type string")
    assert rows(trees.list_tree(table, per_task).select("full_name", "path")) == [
        ("o/r", "README"),
        ("o/r", "src/a.py"),
        ("o/r", "src/deep/b.py"),
        ("o/s", "lib/a.py"),
    ]
    got = trees.read_repositories(spark, "api", "/out", entries=table)
    assert ("o/s", "/out/o/s/lib/a.py") in rows(got)


def test_sources_need_their_input(spark):
    for mode in ("zip", "api", "other"):
        with pytest.raises(ValueError):
            trees.read_repositories(spark, mode, "/out")


def test_list_files(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "a.txt").write_text("12345")
    (tmp_path / "d" / "e" / "b c%20.txt").write_text("")
    (tmp_path / "d" / "__init__.py").write_text("x")
    (tmp_path / ".hidden").write_text("xy")
    got = rows(storage.list_files(spark, str(tmp_path)))
    assert got == [
        (f"{tmp_path}", ".hidden", 2),
        (f"{tmp_path}", "a.txt", 5),
        (f"{tmp_path}/d", "__init__.py", 1),
        (f"{tmp_path}/d/e", "b c%20.txt", 0),
    ]


def test_saving_pages_twice_changes_nothing(spark):
    path = fresh_path(spark, "t")
    table = spark.createDataFrame([(i, f"https://h{i % 3}/en/{i}", f"<p>{i}</p>") for i in range(12)], "page_id int, url string, html string")
    tables.save_pages(table, path)
    once = rows(spark.read.parquet(path))
    tables.save_pages(table, path)
    assert rows(spark.read.parquet(path)) == once and len(once) == 12
    # a newer text replaces its page, pages of other hosts stay
    tables.save_pages(table.filter("page_id = 4").withColumn("html", F.lit("new")), path)
    after = {r["page_id"]: r["html"] for r in spark.read.parquet(path).collect()}
    assert after[4] == "new" and len(after) == 12 and after[1] == "<p>1</p>"
    assert {r["page_id"] for r in tables.read_group(spark, path, "host", "h1").collect()} == {1, 4, 7, 10}


def test_reading_a_group_prunes_folders(spark):
    path = fresh_path(spark, "t")
    table = spark.createDataFrame([(i, f"https://h{i}/en/{i}", "x") for i in range(40)], "page_id int, url string, html string")
    tables.save_pages(table, path)
    one = tables.read_group(spark, path, "host", "h7")
    assert one.count() == 1
    assert len({f.split("part=")[1].split("/")[0] for f in one.inputFiles()}) >= 1
    assert "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().toString()


def test_replace_repo(spark):
    path = fresh_path(spark, "t")
    first = spark.createDataFrame([("a/a", "1", 1), ("a/a", "2", 1), ("b/b", "1", 1)], "full_name string, path string, v int")
    again = spark.createDataFrame([("a/a", "1", 2), ("a/a", "3", 2)], "full_name string, path string, v int")
    tables.replace_repo(first, path)
    tables.replace_repo(again, path)
    tables.replace_repo(again, path)
    assert rows(spark.read.parquet(path).select("full_name", "path", "v")) == [("a/a", "1", 2), ("a/a", "3", 2), ("b/b", "1", 1)]
    merged = fresh_path(spark, "t")
    tables.replace_repo(first, merged)
    tables.replace_repo(again, merged, merge=True)
    assert rows(spark.read.parquet(merged).select("full_name", "path", "v")) == [("a/a", "1", 2), ("a/a", "2", 1), ("a/a", "3", 2), ("b/b", "1", 1)]


def test_manifest_is_in_order(spark):
    path = fresh_path(spark, "m")
    found = spark.createDataFrame([("h", f"https://h/{i:03d}") for i in range(300)] * 2 + [("g", "https://g/1")], "host string, url string")
    seeds = spark.createDataFrame([("h", "https://h/zzz"), ("g", "https://g/1")], "host string, url string")
    manifest.write_manifest(found, seeds, path)
    lines = []
    for name in sorted(glob.glob(f"{path}/host=h/*.txt")):
        with open(name) as text:
            lines += text.read().splitlines()
    assert lines == ["https://h/zzz", *[f"https://h/{i:03d}" for i in range(300)]]
    with open(glob.glob(f"{path}/host=g/*.txt")[0]) as text:
        assert text.read().splitlines() == ["https://g/1", "https://g/1"]


def test_log_numbers_what_happened(spark):
    runs = spark.createDataFrame([(1, True, 5), (2, False, 0)], "id int, ok boolean, k int")
    log = run_log.log_rows(runs, "id", [("start", F.lit(True), F.lit(0)), ("good", F.col("ok"), F.col("k")), ("end", F.lit(True), F.col("k"))])
    assert rows(log) == [(1, 1, "start", 0), (1, 2, "good", 5), (1, 3, "end", 5), (2, 1, "start", 0), (2, 2, "end", 0)]


def test_streams_go_on_where_they_stopped(spark):
    folder, out, routed = (fresh_path(spark, n) for n in ("in", "out", "routed"))
    marks, other = fresh_path(spark, "marks"), fresh_path(spark, "marks")

    def arrive(*texts):
        data = [(f"{i}-{t}", t) for i, t in enumerate(texts)]
        spark.createDataFrame(data, "msg_id string, msg string").coalesce(1).write.mode("append").parquet(folder)
        streams.route_stream(streams.message_stream(spark, folder, 1), routed, other).awaitTermination()
        streams.seen_stream(streams.message_stream(spark, folder, 1), out, marks).awaitTermination()

    arrive("@getcode a", "@getcode a", "hello", "@getcodedoc a")
    arrive("@getcode a", "@getcode b")
    arrive("hello")
    assert rows(spark.read.parquet(out).select("cmd", "arg")) == [("getcode", "a"), ("getcode", "b"), ("getcodedoc", "a")]
    assert spark.read.parquet(routed).count() == 5


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_deep_tree_in_few_rounds(spark, monkeypatch):
    """A chain of 1,000 folders takes at most 11 rounds; circles and lost folders have no path."""
    rounds = []
    staged = trees.stage
    monkeypatch.setattr(trees, "stage", lambda df, label, **m: rounds.append(label) or staged(df, label, **m))
    rows = [("r", f"d{i}", f"d{i - 1}" if i else None, f"n{i}") for i in range(1000)]
    rows += [("r", "a", "b", "a"), ("r", "b", "c", "b"), ("r", "c", "a", "c"), ("r", "in", "a", "in")]
    rows += [("r", "lost", "nowhere", "lost"), ("r", "below", "lost", "below"), ("q", "d5", None, "other")]
    df = spark.createDataFrame(rows, "full_name string, id string, parent string, name string")
    got = {(r.full_name, r.id): r.path for r in trees.folder_paths(df, rows_per_task=50).collect()}
    want = {("r", f"d{i}"): "/".join(f"n{k}" for k in range(i + 1)) for i in range(1000)}
    assert got == {**want, ("q", "d5"): "other"}
    # both passes stage their start and each round
    assert rounds.count("jumps") <= 2 + 2 * 12
    assert trees.folder_paths(df.limit(0)).count() == 0


def test_circles_make_no_long_paths(spark, monkeypatch):
    longest, stage = [0], trees.stage

    def measured(df, label, **metrics):
        out = stage(df, label, **metrics)
        if "path" in out.columns:
            longest.append(out.agg(F.coalesce(F.max(F.length("path")), F.lit(0))).first()[0])
        return out

    monkeypatch.setattr(trees, "stage", measured)
    rows = [("o/r", f"c{i}", f"c{i}", "circle") for i in range(40)] + [("o/r", "a", None, "a"), ("o/r", "b", "a", "b")]
    df = spark.createDataFrame(rows, "full_name string, id string, parent string, name string")
    assert {(r.id, r.path) for r in trees.folder_paths(df).collect()} == {("a", "a"), ("b", "a/b")}
    assert max(longest) == 3


def test_small_archives_are_opened_once(tmp_path, monkeypatch):
    opens, opened = [], archives.opened
    monkeypatch.setattr(archives, "opened", lambda source: opens.append(1) or opened(source))
    paths = [str(tmp_path / f"{i}.zip") for i in range(3)]
    for path in paths[:2]:
        with zipfile.ZipFile(path, "w") as packed:
            packed.writestr("a.txt", "draft")
            packed.writestr("./a.txt", "last")
            packed.writestr("b/", "")
    with open(paths[2], "w") as bad:
        bad.write("no archive")
    got = pd.concat(archives._read_small(iter([pd.DataFrame({"path": paths})])))
    assert got["content"].tolist() == [b"last", b"last", None]
    assert got["problem"].tolist() == [None, None, "bad_archive"]
    assert len(opens) == 3


def test_archives_are_made_a_few_at_a_time():
    import pyarrow as pa

    from checks.queries import _zip_texts

    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(1_200)), "text": ["x"] * 1_200})
    made = list(_zip_texts(iter([docs])))
    assert [len(batch) for batch in made] == [500, 500, 200]
    assert sum((batch.column("doc_id").to_pylist() for batch in made), []) == list(range(1_200))


def test_a_missing_text_is_an_empty_file(tmp_path):
    import io
    import zipfile

    from checks.queries import _zip_repository

    files = pd.DataFrame({"entry": ["a.txt", "b.txt"], "content": [None, "text"]})
    made = _zip_repository(("own/rep", "good"), files)
    with zipfile.ZipFile(io.BytesIO(made["content"][0])) as archive:
        assert {name: archive.read(name) for name in archive.namelist()} == {"a.txt": b"", "b.txt": b"text"}


def _counted(df, seen):
    """Rows as they are, each added to an accumulator when it is read."""

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema)


def test_page_texts_pass_one_join(spark, sf_dir):
    from checks.fixtures import fixture

    lines = fixture(spark, sf_dir, "f_docs")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    at = max((i for i, line in enumerate(lines) if "Project [" in line and "html#" in line), key=lambda i: depth[i])
    joins, level = 0, depth[at]
    for i in range(at, -1, -1):
        if depth[i] < level:
            level = depth[i]
            joins += lines[i].lstrip(" :+-").startswith("Join")
    assert joins == 1


def test_page_texts_are_looked_up_once_for_all_writes(spark):
    from gleanwork.plans.get_docs import DocsRun

    seen, out = spark.sparkContext.accumulator(0), fresh_path(spark, "docs")
    pages = spark.createDataFrame([("h", "k1", 1, "u1", "x"), ("h", "k2", 2, "u2", None)], "folder string, key string, page_id int, url string, html string")
    listed = spark.createDataFrame([("h", "u1"), ("h", "u2")], "host string, url string")
    log = spark.createDataFrame([("r", 1)], "run_id string, step int")
    run = DocsRun(log, listed, _counted(pages, seen), log, listed, listed.limit(1))
    run.write(out, parts=2)
    run.write(out, parts=2)
    assert seen.value == 2
    assert sorted(r["key"] for r in tables.read_table(spark, f"{out}/pages").collect()) == ["k1", "k2"]
    assert tables.read_table(spark, f"{out}/ingested").count() == 4


def test_given_files_are_made_once_for_all_writes(spark, sf_dir, monkeypatch):
    from checks import queries

    seen = spark.sparkContext.accumulator(0)
    files = spark.createDataFrame(
        [("a/b", "/r", f"f{i}", f"text {i}", i % 2 == 0) for i in range(6)], "full_name string, dir string, file string, content string, supported boolean"
    )
    monkeypatch.setattr(queries, "fixture", lambda *_: _counted(files, seen))
    assert queries._stored_files(spark, sf_dir).read().count() == 6
    assert seen.value == 6
