"""Operators against brute force on small tables, with heavy keys forced."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gleanwork.functions.urls import allowed_domain
from gleanwork.operators import catalog, crawl, files, links, pages, skew
from gleanwork.operators.settings import resolve_settings


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows under one key, and copies."""
    rng = random.Random(7)
    left = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(20)}") for i in range(300)]
    right = [(k, j) for k in ["hot", *[f"k{i}" for i in range(0, 20, 2)]] for j in range(3)]
    return spark.createDataFrame(left, "i int, k string"), spark.createDataFrame(right, "k string, j int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("per_task", [7, 1_000_000])
def test_split_join_is_the_plain_join(hot, how, per_task):
    left, right = hot
    load = skew.key_load(left, ["k"], per_task)
    assert rows(skew.split_join(left, right, ["k"], ["i"], load, how)) == rows(left.join(right, ["k"], how))


def test_split_join_in_a_grid(hot):
    left, right = hot
    got = skew.split_join(
        left, right, ["k"], ["i"], skew.key_load(left, ["k"], 7), right_spread=["j"], right_load=skew.key_load(right, ["k"], 2)
    )
    assert rows(got) == rows(left.join(right, ["k"]))


def test_heavy_key_is_spread(spark, hot):
    left, _ = hot
    splits = skew.key_load(left, ["k"], 10).splits()
    assert {r["k"]: r["_splits"] for r in splits.collect()}["hot"] == 10


def test_join_present_keeps_rows_without_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, k string")
    right = spark.createDataFrame([("a", 9)], "k string, v int")
    got = skew.join_present(left, right, ["k"], ["i"]).select("i", "k", "v")
    assert rows(got) == [(1, "a", 9), (2, None, None), (3, "b", None)]


def test_number_rows_counts_over_all_tasks(spark):
    rng = random.Random(3)
    data = [("hot" if i % 3 else rng.choice(["a", "b", None]), rng.random()) for i in range(500)]
    df = spark.createDataFrame(data, "g string, v double")
    got = rows(skew.number_rows(df, ["g"], ["v"], "n"))
    want = []
    for g in {g for g, _ in data}:
        for n, v in enumerate(sorted(v for h, v in data if h == g), 1):
            want.append((g, v, n))
    assert got == sorted(want, key=lambda r: [(v is None, str(v)) for v in r])


NAMES = ["facebook/react", "react/react", "Foo/Bar", "a/b", "foo/bar", "vuejs/core", "a/b", "x/reactive", "o/Ünï", "o/a.b*c"]


@pytest.mark.parametrize("per_task", [2, 1_000_000])
def test_name_search_is_the_full_comparison(spark, per_task):
    cat = spark.createDataFrame([(i, n, "u" + n) for i, n in enumerate(NAMES)], "rank bigint, full_name string, html_url string")
    terms = ["react", "REACT", "", "a", "/b", "r/b", "zzz", "foo/bar", "vuejs/core", "ünï", ".b*", "reactivex", "facebook/react"]
    got = catalog.name_search(spark.createDataFrame([(t,) for t in terms], "q string"), cat, per_task)
    want = [(t, i) for t in terms for i, n in enumerate(NAMES) if t.lower() in n.lower()]
    assert rows(got) == sorted(want, key=lambda r: [(v is None, str(v)) for v in r])


def test_find_repo_first_exact_or_all(spark):
    cat = spark.createDataFrame([(i, n, "u" + n) for i, n in enumerate(NAMES)], "rank bigint, full_name string, html_url string")
    asked = spark.createDataFrame(
        [(1, "a/b"), (2, "foo/bar"), (3, "FOO/BAR"), (4, "react"), (5, "react"), (6, "nope"), (7, None), (8, "vuejs")],
        "req_id int, q string",
    )
    found = {}
    for r in catalog.find_repo(asked, cat, rows_per_task=1).collect():
        found.setdefault(r["req_id"], []).append((r["rank"], r["exact"]))
    assert found[1] == [(3, True)]  # two of that name, the first counts
    assert found[2] == [(4, True)]  # case matters for exact hits
    assert sorted(found[3]) == [(2, False), (4, False)]
    assert sorted(found[4]) == sorted(found[5]) == [(0, False), (1, False), (7, False)]
    assert 6 not in found and 7 not in found
    status = {r["req_id"]: r for r in catalog.request_status(asked, cat).collect()}
    assert [status[i]["status"] for i in range(1, 9)] == ["download", "download", "list", "list", "list", "not_found", "not_found", "download"]
    assert status[8]["exact"] is False and status[8]["full_name"] == "vuejs/core"
    lines = catalog.numbered_list(asked, cat, rows_per_task=1).filter("req_id = 4").orderBy("line_no").collect()
    assert [r["line"] for r in lines] == [
        "I found the following libraries on github:",
        "1. [facebook/react](ufacebook/react)",
        "2. [react/react](ureact/react)",
        "3. [x/reactive](ux/reactive)",
    ]


HTML = """
<base href="/root/"><a href="x">1</a> <a class='c' HREF='x'>again</a><a
 href = y?a=1&amp;b=2>2</a><area href="//other.org/z"><a data-href="no" href="#f">3</a>
<!-- <a href="hidden"> --><script>var s = '<a href="code">';</script><style>a{}</style>
<a name="none">4</a><a href="mailto:a@b.c">5</a><a href="javascript:void(0)">6</a><abbr href="no">7</abbr>
<a href="../up">8</a><a href="https://h.org/Ü?q=%20">9</a><link href="sheet.css"><a href="">10</a>
"""


def test_a_result_is_written_once_per_request_in_a_row(spark):
    """The output grows with requests times results, so it is made by all tasks and in runs that take little room."""
    from itertools import groupby

    from gleanwork.session import task_count

    cat = spark.createDataFrame([(i, f"own/ring-{i}", f"u{i}") for i in range(40)], "rank int, full_name string, html_url string")
    asked = spark.createDataFrame([(i, "ring-") for i in range(50)], "req_id int, q string")
    for made, column, n in ((catalog.find_repo(asked, cat), "rank", 40), (catalog.numbered_list(asked, cat), "line_no", 41)):
        values = [row[column] for row in made.collect()]
        assert len(values) == 50 * n
        assert len(list(groupby(values))) == n
        assert made.rdd.getNumPartitions() == task_count(spark)


def test_extract_links(spark):
    table = spark.createDataFrame([(1, "https://h.org/d/p", HTML), (2, "https://h.org/d/p", "none"), (3, "https://h.org/", None)], "page_id int, url string, html string")
    got = [r["abs_url"] for r in links.extract_links(table).collect()]
    assert got == [
        "https://h.org/root/x",
        "https://h.org/root/y?a=1&b=2",
        "https://other.org/z",
        "https://h.org/root/#f",
        "https://h.org/up",
        "https://h.org/Ü?q=%20",
        "https://h.org/root/",
    ]
    edges = links.link_edges(table)
    assert {r["host"] for r in edges.collect()} == {"h.org", "other.org"}
    assert edges.filter(F.contains("dst", F.lit("#"))).isEmpty()


def walk(edges, hosts, seed, domain, depth, cap, include_seed):
    """Level by level, nodes in order, the cap over the whole walk."""
    depths, newest = ({seed: 0} if include_seed else {}), [seed]
    for level in range(1, depth + 1):
        found = {
            d
            for s, d in edges
            if s in newest and (hosts[d] == domain or hosts[d].endswith("." + domain)) and d not in depths
        }
        newest = sorted(found)
        if cap is not None:
            newest = newest[: max(cap - len(depths), 0)]
        depths.update({d: level for d in newest})
    return [(seed, n, d) for n, d in depths.items()]


@pytest.mark.parametrize("cap", [None, 1, 4, 100])
@pytest.mark.parametrize("include_seed", [True, False])
@pytest.mark.parametrize("per_task", [3, 1_000_000])
def test_crawl_is_a_walk_by_levels(spark, cap, include_seed, per_task, monkeypatch):
    if per_task == 3:
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    rng = random.Random(11)
    hosts = {n: rng.choice(["a.org", "d.a.org", "b.org", "xa.org"]) for n in range(40)}
    # page 0 is linked by all and links to all; copies of edges, cycles, self links
    edges = [(n, rng.randrange(40)) for n in range(40) for _ in range(3)]
    edges += [(n, 0) for n in range(40)] + [(0, n) for n in range(40)] + [(5, 5), (5, 6), (6, 5)] + [(7, 8)] * 30
    table = spark.createDataFrame([(s, d, hosts[d]) for s, d in edges], "src int, dst int, host string")
    starts = [(0, "a.org"), (5, "b.org"), (7, "a.org"), (9, "none.org"), (11, "org")]
    seeds = spark.createDataFrame([(n, d, n) for n, d in starts], "seed int, domain string, node int")
    got = rows(crawl.crawl(table, seeds, 3, cap, include_seed, per_task))
    want = [r for n, d in starts for r in walk(edges, hosts, n, d, 3, cap, include_seed)]
    assert got == sorted(want, key=lambda r: [(v is None, str(v)) for v in r])


def test_crawl_without_links_or_depth(spark):
    empty = spark.createDataFrame([], "src int, dst int, host string")
    seeds = spark.createDataFrame([(1, "a.org", 1)], "seed int, domain string, node int")
    assert rows(crawl.crawl(empty, seeds)) == [(1, 1, 0)]
    assert rows(crawl.crawl(empty, seeds, include_seed=False)) == []
    table = spark.createDataFrame([(1, 2, "a.org")], "src int, dst int, host string")
    assert rows(crawl.crawl(table, seeds, depth=0)) == [(1, 1, 0)]


def test_accumulate_counts_earlier_pages(spark):
    before = spark.createDataFrame([(1, 50), (1, 51), (1, 51), (2, 60), (2, 61), (2, 62)], "seed int, node int")
    found = spark.createDataFrame([(1, 1, 0), (1, 51, 1), (1, 2, 1), (1, 3, 2), (2, 2, 0)], "seed int, node int, depth int")
    assert rows(crawl.accumulate(before, found, 3)) == [(1, 1), (1, 50), (1, 51), (2, 60), (2, 61), (2, 62)]


def test_first_branch_is_null_without_candidates(spark):
    table = spark.createDataFrame([("a/a", "latest"), ("a/a", "master"), ("b/b", "dev")], "full_name string, branch string")
    assert rows(files.first_branch(table)) == [("a/a", "master"), ("b/b", None)]


@pytest.mark.parametrize("per_task", [1, 1_000_000])
def test_ingest_statuses(spark, per_task):
    table = spark.createDataFrame(
        [("d", "1", True, "u1"), ("d", "2", False, "u2"), ("d", "3", False, "u3"), ("d", "4", None, "u2")],
        "dir string, file string, supported boolean, raw_url string",
    )
    known = spark.createDataFrame([("u1",), ("u2",), ("u2",)], "raw_url string")
    got = files.ingest_with_fallback(table, known, rows_per_task=per_task)
    assert {r["file"]: r["status"] for r in got.collect()} == {"1": "local", "2": "raw", "3": "failed", "4": "raw"}
    off = files.ingest_with_fallback(table, known, fallback=False)
    assert {r["file"]: r["status"] for r in off.collect()} == {"1": "local", "2": "failed", "3": "failed", "4": "failed"}
    counts = files.attempt_count(got.withColumn("g", F.lit(1)), ["g"]).first()
    assert counts["attempted"] == counts["local"] + counts["raw"] + counts["failed"] == 4


def test_skip_existing_takes_first_of_equal_keys(spark):
    new = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (4, "c")], "i int, k string")
    old = spark.createDataFrame([("c",), ("c",)], "k string")
    assert rows(files.skip_existing(new, old, ["k"], "i").select("k", "i")) == [("a", 2), ("b", 1)]
    assert rows(files.skip_existing(new, None, ["k"], "i").select("k", "i")) == [("a", 2), ("b", 1), ("c", 4)]


def test_settings_defaults(spark):
    asked = spark.createDataFrame([(1,), (2,)], "req_id int")
    stored = spark.createDataFrame([(1, True, None)], "req_id int, use_api boolean, scraping_depth int")
    got = {r["req_id"]: r for r in resolve_settings(asked, stored).collect()}
    assert (got[1]["use_api"], got[1]["scraping_depth"], got[1]["use_chrome"]) == (True, 3, True)
    assert (got[2]["use_api"], got[2]["scraping_max_pages"], got[2]["github_api_key"]) == (False, 100, None)


def test_parity_key_loses_what_collisions_report(spark):
    urls = ["https://h/en/1", "https://h/en/2", "https://h/en/3/", "https://h", "https://g/en/1"]
    table = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    lost = pages.key_collisions(table).collect()
    assert [(r["host"], r["key"], r["n_lost"], r["kept_page"]) for r in lost] == [("h", "en", 1, 1)]
    assert pages.keyed_pages(table, parity=True).count() == len(urls) - 1
    assert pages.keyed_pages(table).count() == len(urls)


def test_allowed_domain_equals_join_key(spark):
    from gleanwork.functions.urls import host_domains

    table = spark.createDataFrame([(h, d) for h in ("a.b.c", "b.c", "xb.c") for d in ("b.c", "c", "a.b.c", "d")], "h string, d string")
    differs = table.filter(allowed_domain("h", "d") != F.array_contains(host_domains("h"), F.col("d")))
    assert differs.isEmpty()


def test_every_heavy_key_is_spread(spark):
    left = spark.range(4500).selectExpr("id % 1500 k", "id i")
    right = spark.range(1500).selectExpr("id k", "id * 2 j")
    load = skew.key_load(left, ["k"], 2)
    assert load.splits().filter("_splits = 2").count() == 1500
    joined = skew.split_join(left, right, ["k"], ["i"], load)
    assert joined.filter("j = 2 * k").count() == joined.count() == 4500


def _read_for_broadcast(df):
    """Columns of the files that are read for broadcasts."""
    found, at = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        at = None if at is not None and depth <= at else at
        if "BroadcastExchange" in line:
            at = depth if at is None else at
        elif at is not None and "FileScan" in line:
            found += re.findall(r"(\w+)#", line.split("]")[0])
    return found


def test_names_are_never_a_broadcast(spark, tmp_path):
    """Files of names are small, their rows are not, and a broadcast passes through the driver."""
    names = spark.range(3000).selectExpr("id rank", "concat('own', id % 9, '/ring-', id % 50) full_name", "concat('https://x/', id % 9) html_url")
    names.write.parquet(str(tmp_path / "names"))
    cat = spark.read.parquet(str(tmp_path / "names"))
    asked = spark.createDataFrame([(1, "own3/ring-3"), (2, "wn5/ring-4"), (3, "ring-49"), (4, "zzz")], "req_id int, q string")
    found = catalog.find_repo(asked, cat)
    status = catalog.request_status(asked, cat)
    lines = catalog.numbered_list(asked, cat)
    hits = catalog.name_search(asked.select("q"), cat)
    for made in (found, status, lines, hits):
        assert not {"full_name", "html_url", "rank"} & set(_read_for_broadcast(made))
    # the few terms still are one, so the pieces of names stay where they are
    assert "piece" in _read_for_broadcast(hits)
    plain = names.toPandas()
    for q in ("wn5/ring-4", "ring-49"):
        want = sorted(plain[plain["full_name"].str.contains(q, regex=False)]["rank"])
        assert sorted(r["rank"] for r in hits.filter(F.col("q") == q).collect()) == want
    assert {r["req_id"]: r["n_results"] for r in status.collect()} == {1: 1, 2: hits.filter("q = 'wn5/ring-4'").count(), 3: 60, 4: 0}


def test_settings_are_never_a_broadcast(spark, tmp_path):
    spark.range(2000).selectExpr("id req_id", "'key' github_api_key", "true use_api").write.parquet(str(tmp_path / "settings"))
    got = resolve_settings(spark.range(2500).selectExpr("id req_id"), spark.read.parquet(str(tmp_path / "settings")))
    assert not _read_for_broadcast(got)
    assert got.filter("github_api_key = 'key'").count() == 2000 and got.count() == 2500


def test_catalog_and_settings_are_moved_by_key_in_inputs(spark, tmp_path):
    from checks.fixtures import fixture
    from checks.queries import QUERIES

    made = {
        "part": "id p_partkey, concat('ring ', id % 7) p_name, concat('Brand#', id % 5) p_brand, 'PROMO' p_type, 1 p_size, 1D p_retailprice",
        "customer": "id c_custkey, concat('c', id) c_name, 9 c_nationkey, 1D c_acctbal, 'FURNITURE' c_mktsegment",
        "conversations": "id conv_id, 0L turn, 'user' role, concat('text ', id) text",
        "pages": "id page_id, concat('https://a.example.com/', id) url, '' html",
        "events": "id event_id, timestamp_ntz'2024-01-01 00:00:00' ts, id user_id, 'view' event_type, 1D value, '' props",
    }
    for name, columns in made.items():
        spark.sql(f"select {columns} from range(60)").write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("f_requests", "f_messages", "f_timed_messages", "f_run_settings"):
        got = fixture(spark, str(tmp_path), name)
        assert not {"p_partkey", "c_custkey"} & set(_read_for_broadcast(got)), name
        assert got.count() == 60
    firsts = QUERIES["first_by_rank"](spark, str(tmp_path))
    assert not {"p_partkey", "c_custkey"} & set(_read_for_broadcast(firsts))
    assert firsts.filter("rank = req_id % 35").count() == firsts.count() == 60


def test_first_by_rank_cuts_hits_before_its_sort(spark):
    rows = [(i % 3 or None, None if i % 7 == 0 else 100 - i, f"o/{i % 2}") for i in range(60)]
    hits = spark.createDataFrame(rows, "req_id int, rank int, full_name string")
    got = catalog.first_by_rank(hits)
    plain = skew.first_per_group(hits, ["req_id"], "rank")
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert got.columns == hits.columns
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # one row per distinct result comes to the sort
    assert "Aggregate" in plan[plan.index("Window"):]
