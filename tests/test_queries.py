"""Every registered query against its SQL."""

import pytest

from checks.compare import database, difference
from checks.oracle import ORACLE
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.fixture(scope="module")
def larger():
    return database("/root/testdata/sf0.01")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, name) is None


def test_fixtures_reach_every_branch(larger):
    """A query that matches on one branch only would prove little."""

    def values(name, column):
        return {row[0] for row in larger.execute(f"select distinct {column} from ({ORACLE[name]})").fetchall()}

    assert values("request_status", "status") == {"not_found", "download", "list"}
    assert values("request_status", "exact") == {True, False}
    assert values("search_payload_status", "status") == {"ok", "empty", "bad_payload"}
    assert values("ingest_with_fallback", "status") == {"local", "raw", "failed"}
    assert values("first_branch", "branch") == {"main", "master", "latest", None}
    assert values("search_and_fetch_mode", "fetch_mode") == {"api", "zip"}
    assert values("pick_profile", "browser") == {"chromium", "firefox"}
    assert values("crawl_sites", "depth") == {0, 1, 2, 3}
    assert values("get_code_answered_status", "status") == {"not_found", "empty", "bad_payload", "list", "download", "download_failed", "missing_archive", "bad_archive"}
    assert values("get_code_ingested", "status") == {"local", "raw", "failed"}
    assert values("get_docs_outcomes", "outcome") == {"crawled", "no_browser", "crawl_failed"}
    assert values("get_code_status", "status") >= {"not_found", "download", "list"}


def test_cap_cuts_something(larger):
    n = {name: larger.execute(f"select count(*) from ({ORACLE[name]})").fetchone()[0] for name in ("crawl_sites", "page_cap")}
    assert n["page_cap"] < n["crawl_sites"]


def test_tasks_need_no_copy_of_the_package(tmp_path):
    """Python tasks run although their workers cannot import the package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "from checks.queries import QUERIES\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "for name in ('unzip_entries', 'list_files', 'read_repositories_zip'):\n"
        "    print(name, QUERIES[name](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "read_repositories_zip 400" in done.stdout, done.stderr[-2000:]
