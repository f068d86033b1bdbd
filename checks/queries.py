"""One query per operator: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import fixture
from gleanwork.functions import requests as R
from gleanwork.functions import urls as U
from gleanwork.operators import catalog, crawl, files, links, pages, resume
from gleanwork.operators import name_index as name_lookup
from gleanwork.operators.settings import resolve_settings
from gleanwork.operators.skew import first_per_group, last_per_group
from gleanwork.plans.answered import get_code_answered
from gleanwork.plans.get_code import get_code
from gleanwork.plans.get_docs import get_docs
from gleanwork.session import fresh_path, stage
from gleanwork.sinks import manifest, run_log, tables
from gleanwork.sinks.file_store import FileStore
from gleanwork.sources import archives, formats, search, storage, trees
from gleanwork.sources.requests import read_requests
from gleanwork.sources.storage import open_store
from gleanwork.streaming import requests as streams
from gleanwork.streaming.seen import write_seen

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


# --- sources -----------------------------------------------------------------


@query
def read_search_raw(spark, sf):
    return search.read_search_raw(fixture(spark, sf, "f_search_raw"), ["rank"])


@query
def read_search_api(spark, sf):
    return search.read_search_api(fixture(spark, sf, "f_search_api"), ["rank"])


@query
def search_payload_status(spark, sf):
    raw = fixture(spark, sf, "f_search_raw").select("rank", F.lit("raw").alias("mode"), search.payload_status("js", "raw").alias("status"))
    api = fixture(spark, sf, "f_search_api").select("rank", F.lit("api").alias("mode"), search.payload_status("js", "api").alias("status"))
    return raw.unionByName(api)


@query
def read_requests_from_chat(spark, sf):
    return read_requests(fixture(spark, sf, "f_messages"), ["msg_id"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Rows a few at a time, as a batch's texts and archives take much more room as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            yield batch.slice(start, 500).to_pandas()


def _zip_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One archive per document: a folder, its text, and a second entry of the same name."""
    for batch in _slices(batches):
        packed = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("main/", "")
                archive.writestr("main/text.txt", text)
                archive.writestr("../main/id.txt", "draft")
                archive.writestr("main/id.txt", str(doc_id))
            packed.append(buffer.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array(batch["doc_id"], pa.int64(), from_pandas=True), pa.array(packed, pa.binary())], ["doc_id", "content"])


def _document_archives(spark, sf) -> DataFrame:
    docs = fixture(spark, sf, "documents").select("doc_id", "text")
    return docs.mapInArrow(_zip_texts, "doc_id bigint, content binary")


@query
def unzip_entries(spark, sf):
    unpacked = archives.unzip(_document_archives(spark, sf), ["doc_id"])
    return unpacked.select("doc_id", "entry", "n", F.sha2("data", 256).alias("digest"), "problem")


def _save_archives(packed: DataFrame, folder: str, prefix: str = "rep") -> None:
    """Rows ``doc_id, content`` as files by owner."""

    def save(batches):
        for batch in _slices(batches):
            for doc_id, content in zip(batch["doc_id"], batch["content"]):
                store, owner = open_store(f"{folder}/own{doc_id % 10}")
                store.create_dir(owner, recursive=True)
                with store.open_output_stream(f"{owner}/{prefix}{doc_id}.zip") as out:
                    out.write(content)
            yield pa.RecordBatch.from_pydict({"n": [len(batch)]})

    packed.mapInArrow(save, "n bigint").agg(F.sum("n")).collect()


@query
def read_repositories_zip(spark, sf):
    """The zip source: archives are written as files by owner and read back unpacked."""
    folder = fresh_path(spark, "archives")
    _save_archives(_document_archives(spark, sf), folder)
    return trees.read_repositories(spark, "zip", "/data/repos", folder=folder)


def _entries(df: DataFrame) -> DataFrame:
    """Unpacked entries with a digest in place of their content."""
    name = F.regexp_extract("path", "([^/]+/[^/]+)[.]zip$", 1).alias("full_name")
    return df.select(name, "entry", "n", "piece", F.sha2("content", 256).alias("digest"), "problem")


@query
def archive_contents(spark, sf):
    """Archives as a data source, with their content; half of the files are no archives."""
    folder = fresh_path(spark, "archives")
    _save_archives(_document_archives(spark, sf), folder)
    texts = fixture(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    _save_archives(texts, folder, "text")
    formats.register_formats(spark)
    return _entries(spark.read.format("archives").option("path", folder).load())


@query
def archives_stream(spark, sf):
    """Archives that come in two deliveries, read by a stream that starts anew for the second."""
    folder, out, checkpoint = (fresh_path(spark, name) for name in ("archives", "unpacked", "offsets"))
    formats.register_formats(spark)
    packed = _document_archives(spark, sf)
    for later in (False, True):
        _save_archives(packed.filter((F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0) == F.lit(later)), folder)
        found = _entries(spark.readStream.format("archives").option("path", folder).load())
        query = found.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
        query.awaitTermination()
    return spark.read.parquet(out)


@query
def list_tree(spark, sf):
    return trees.list_tree(fixture(spark, sf, "f_tree"))


@query
def list_deep_tree(spark, sf):
    return trees.list_deep_tree(fixture(spark, sf, "f_deep_tree"))


@query
def read_repositories_api(spark, sf):
    return trees.read_repositories(spark, "api", "/data/repos", entries=fixture(spark, sf, "f_tree"))


@query
def list_files(spark, sf):
    """Folders of a walked tree, after the documents were written into it."""
    folder = fresh_path(spark, "walk")
    docs = fixture(spark, sf, "documents").select("source", "lang", F.regexp_replace("text", "\\s+", " ").alias("value"))
    docs.hint("rebalance", "source", "lang").write.partitionBy("source", "lang").text(folder)
    walked = storage.list_files(spark, folder).filter(F.col("file").endswith(".txt"))
    below = F.regexp_extract("dir", "([^/]+/[^/]+)$", 1)
    return walked.groupBy(below.alias("dir")).agg(F.sum("length").alias("n_bytes"))


@query
def read_pages(spark, sf):
    return fixture(spark, sf, "pages").select(
        "page_id", "url", U.url_netloc("url").alias("host"), F.length("html").alias("n_chars")
    )


# --- projections and predicates ----------------------------------------------


@query
def url_netloc(spark, sf):
    # the same address with a port and a user, and without a scheme
    return fixture(spark, sf, "pages").select(
        "page_id",
        U.url_netloc("url").alias("netloc"),
        U.url_netloc(F.replace("url", F.lit(".example"), F.lit(" x.example"))).alias("with_blank"),
        U.url_netloc(F.regexp_replace("url", "^(https?)://([^/?#]*)", "$1://me@$2:8080")).alias("with_port"),
        U.url_host(F.regexp_replace("url", "^(https?)://([^/?#]*)", "$1://me@$2:8080")).alias("host"),
        U.url_netloc(F.regexp_replace("url", "^https?://", "")).alias("no_scheme"),
    )


@query
def strip_highlight(spark, sf):
    marked = F.concat(F.lit("<em>"), F.replace("p_name", F.lit(" "), F.lit("</em>&#x2F;")), F.lit("&amp;"), "p_brand")
    return fixture(spark, sf, "part").select("p_partkey", R.strip_highlight(marked).alias("name"))


@query
def repo_urls(spark, sf):
    out = F.lit("/data/repos")
    return fixture(spark, sf, "f_catalog").select(
        "rank",
        U.repo_url("full_name").alias("repo_url"),
        U.archive_url("full_name", F.lit("main")).alias("archive_url"),
        U.repo_owner("full_name").alias("owner"),
        U.repo_name("full_name").alias("repo"),
        U.archive_path(out, "full_name").alias("archive_path"),
        U.extraction_folder(out, "full_name").alias("extraction_folder"),
    )


@query
def raw_file_url(spark, sf):
    listed = fixture(spark, sf, "f_files")
    return files.raw_urls(listed, "full_name", F.lit("main")).select("doc_id", "relpath", "raw_url")


@query
def raw_file_url_parity(spark, sf):
    listed = fixture(spark, sf, "f_files").withColumn("root", F.lit("/data/repos"))
    return files.raw_urls(listed, "full_name", F.lit("main"), parity=True).select("doc_id", "relpath", "raw_url")


@query
def page_key(spark, sf):
    return fixture(spark, sf, "pages").select(
        "page_id", U.page_key("url").alias("short_key"), U.page_digest("url").alias("key")
    )


@query
def allowed_domain(spark, sf):
    """Links whose target lies in the registered site of the page they are on."""
    edges = fixture(spark, sf, "f_links")
    sites = fixture(spark, sf, "f_sites").select(F.col("page_id").alias("src"), "site")
    return edges.join(sites, "src").filter(U.allowed_domain("host", "site")).select("src", "dst", "host", "site")


@query
def handled_entries(spark, sf):
    return fixture(spark, sf, "f_tree").filter(trees.handled_entry("type")).groupBy("full_name", "type").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def to_flag(spark, sf):
    return fixture(spark, sf, "f_settings").select("req_id", R.to_flag("save_pages").alias("save_pages"))


@query
def setting_flag(spark, sf):
    return fixture(spark, sf, "f_settings").select(
        "req_id", R.setting_flag("use_api", False).alias("use_api"), R.setting_flag("use_chrome", True).alias("use_chrome")
    )


@query
def resolved_settings(spark, sf):
    return resolve_settings(fixture(spark, sf, "f_requests").select("req_id"), fixture(spark, sf, "f_settings"))


@query
def search_and_fetch_mode(spark, sf):
    resolved = resolve_settings(fixture(spark, sf, "f_requests").select("req_id"), fixture(spark, sf, "f_settings"))
    return resolved.select(
        "req_id",
        R.search_mode("github_api_key").alias("search_mode"),
        R.fetch_mode("github_api_key", "use_api").alias("fetch_mode"),
        R.fetch_mode("github_api_key", "use_api", parity=True).alias("fetch_mode_parity"),
    )


@query
def pick_profile(spark, sf):
    resolved = resolve_settings(fixture(spark, sf, "f_requests").select("req_id"), fixture(spark, sf, "f_settings"))
    return resolved.select(
        "req_id", R.pick_profile("req_id", "use_chrome", "use_firefox", "use_webkit").alias("browser")
    )


@query
def resolve_href(spark, sf):
    """Page names as links of every form, resolved against the page address."""
    base = fixture(spark, sf, "pages").select("page_id", "url")
    key = F.concat(F.lit("k"), F.col("page_id").cast("string"))
    forms = F.map_from_arrays(
        F.array(*[F.lit(n) for n in ("root", "host", "absolute", "fragment", "query", "relative", "up", "empty")]),
        F.array(
            F.concat(F.lit("/"), key),
            F.concat(F.lit("//h.org/"), key),
            F.concat(F.lit("http://h.org/"), key),
            F.concat(F.lit("#"), key),
            F.concat(F.lit("?q="), key),
            F.concat(key, F.lit("?a=1")),
            F.concat(F.lit("../"), key),
            F.lit(""),
        ),
    )
    return base.select("page_id", "url", F.explode(forms).alias("form", "href")).select(
        "page_id", "form", U.resolve_href("href", "url").alias("abs_url")
    )


# --- search -------------------------------------------------------------------


@query
def name_search(spark, sf):
    terms = fixture(spark, sf, "f_requests").select("q").distinct()
    return catalog.name_search(terms, fixture(spark, sf, "f_catalog"))


@query
def name_index(spark, sf):
    """Search in a stored index after names have come, gone and changed, and after it was compacted."""
    names = fixture(spark, sf, "f_catalog").select(F.col("rank").alias("id"), F.col("full_name").alias("name"))
    other = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    index = name_lookup.NameIndex(spark, fresh_path(spark, "index"))
    wrong = names.filter(other).select("id", F.concat(F.lit("old-"), "name").alias("name"))
    index.update(added=names.filter(~other).unionByName(wrong))
    index.update(added=names, removed=wrong)
    index.compact()
    # comes and goes again
    index.update(added=wrong)
    index.update(removed=wrong)
    terms = fixture(spark, sf, "f_requests").select("q").unionByName(names.select(F.substring("name", 4, 2).alias("q")))
    return index.lookup(terms).withColumnRenamed("id", "rank")


@query
def find_repo(spark, sf):
    return catalog.find_repo(fixture(spark, sf, "f_requests"), fixture(spark, sf, "f_catalog"))


@query
def first_by_rank(spark, sf):
    # names are far smaller in their files than in memory: never a broadcast
    cat = fixture(spark, sf, "f_catalog").hint("merge")
    asked = fixture(spark, sf, "f_requests")
    hits = asked.join(cat, asked["q"] == cat["full_name"]).select("req_id", "rank", "full_name", "html_url")
    return catalog.first_by_rank(hits)


@query
def request_status(spark, sf):
    return catalog.request_status(fixture(spark, sf, "f_requests"), fixture(spark, sf, "f_catalog"))


@query
def result_count(spark, sf):
    return catalog.result_count(fixture(spark, sf, "f_requests"), fixture(spark, sf, "f_catalog"))


@query
def numbered_list(spark, sf):
    return catalog.numbered_list(fixture(spark, sf, "f_requests"), fixture(spark, sf, "f_catalog"))


# --- files ---------------------------------------------------------------------


@query
def first_branch(spark, sf):
    return files.first_branch(fixture(spark, sf, "f_branches"))


def _ingested(spark, sf, fallback: bool = True) -> DataFrame:
    found = files.raw_urls(fixture(spark, sf, "f_files"), "full_name", F.lit("main"))
    return files.ingest_with_fallback(found, fixture(spark, sf, "f_raw_available"), fallback)


@query
def ingest_with_fallback(spark, sf):
    return _ingested(spark, sf).select("doc_id", "relpath", "raw_url", "status")


@query
def ingest_without_fallback(spark, sf):
    return _ingested(spark, sf, fallback=False).select("doc_id", "status")


@query
def attempt_count(spark, sf):
    return files.attempt_count(_ingested(spark, sf), ["full_name"])


@query
def skip_existing(spark, sf):
    new = fixture(spark, sf, "pages").select("page_id", "url")
    return files.skip_existing(new, fixture(spark, sf, "f_existing"), ["url"], "page_id")


@query
def skip_existing_repeated(spark, sf):
    """Repeated rows, keys that tie, and rows without a key."""
    new = fixture(spark, sf, "f_sites").select("page_id", F.when(~F.col("site").endswith(".org"), F.col("site")).alias("site"), "url")
    known = fixture(spark, sf, "f_existing").select(F.col("url")).join(new.select("url", "site"), "url").select("site").distinct()
    return files.skip_existing(new.unionByName(new), known, ["site"], "page_id")


# --- links, crawl, pages ----------------------------------------------------------


@query
def extract_links(spark, sf):
    return links.extract_links(fixture(spark, sf, "pages")).select("page_id", "abs_url")


@query
def extract_links_all_tags(spark, sf):
    return links.extract_links(fixture(spark, sf, "f_docs")).select("page_id", "abs_url")


@query
def scan_links(spark, sf):
    return links.scanned_links(fixture(spark, sf, "pages")).select("page_id", "abs_url")


@query
def scan_odd_links(spark, sf):
    return links.scanned_links(fixture(spark, sf, "f_odd_pages")).select("page_id", "abs_url")


def _site_seeds(spark, sf) -> DataFrame:
    """Every page is the start of a crawl of its site."""
    return fixture(spark, sf, "f_sites").select(
        F.col("page_id").alias("seed"), F.col("site").alias("domain"), F.col("page_id").alias("node")
    )


@query
def crawl_sites(spark, sf):
    return crawl.crawl(fixture(spark, sf, "f_links"), _site_seeds(spark, sf), depth=3, max_pages=100)


@query
def crawl_unlimited(spark, sf):
    return crawl.crawl(fixture(spark, sf, "f_links"), _site_seeds(spark, sf), depth=4, max_pages=None)


@query
def page_cap(spark, sf):
    return crawl.crawl(fixture(spark, sf, "f_links"), _site_seeds(spark, sf), depth=3, max_pages=5)


@query
def depth_limit(spark, sf):
    """Each crawl with its own depth and page limit, seeds counted only when linked to."""
    seeds = _site_seeds(spark, sf)
    own = seeds.withColumn("max_depth", 1 + F.col("seed") % 3).withColumn("max_pages", 3 + F.col("seed") % 9)
    return crawl.crawl(fixture(spark, sf, "f_links"), own, depth=3, max_pages=11, include_seed=False)


def _limited_seeds(spark, sf) -> DataFrame:
    """Site crawls of which some name no limit, some a larger and some a smaller one than the common one."""
    seeds = _site_seeds(spark, sf)
    own_depth = F.when(F.col("seed") % 4 == 0, F.lit(4)).when(F.col("seed") % 4 == 1, F.lit(1))
    own_pages = F.when(F.col("seed") % 5 == 0, F.lit(30)).when(F.col("seed") % 5 < 3, F.col("seed") % 5 + 2)
    return seeds.withColumn("max_depth", own_depth).withColumn("max_pages", own_pages)


@query
def crawl_own_limits(spark, sf):
    return crawl.crawl(fixture(spark, sf, "f_links"), _limited_seeds(spark, sf), depth=2, max_pages=6)


@query
def crawl_resumed(spark, sf):
    """Pages, links and seeds that arrive in three runs, the last one with all of them again."""
    links_, seeds = fixture(spark, sf, "f_links"), _limited_seeds(spark, sf)
    nodes = fixture(spark, sf, "pages").select(F.col("page_id").alias("node"))
    first = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)) > 0
    store = resume.CrawlStore(spark, fresh_path(spark, "crawls"), pages_needed=True)
    store.update(links_.filter(first("src", 3)), nodes.filter(first("node", 4)), seeds.filter(first("seed", 5)), depth=2, max_pages=6)
    store.update(links_.filter(~first("src", 3)), None, seeds.filter(~first("seed", 5)), depth=2, max_pages=6)
    store.update(links_, nodes, seeds, depth=2, max_pages=6)
    return store.found()


@query
def accumulate(spark, sf):
    """Crawls that start with pages found by an earlier, shallower crawl."""
    edges, seeds = fixture(spark, sf, "f_links"), _site_seeds(spark, sf)
    earlier = fixture(spark, sf, "f_existing").select(F.col("page_id").alias("seed"), F.col("page_id").alias("node"))
    return crawl.accumulate(earlier, crawl.crawl(edges, seeds, depth=2, max_pages=6, include_seed=False), 6)


@query
def distinct_urls(spark, sf):
    found = links.extract_links(fixture(spark, sf, "pages"))
    return crawl.distinct_urls(found.withColumn("host", U.url_netloc("url")), "host", "abs_url")


@query
def page_count(spark, sf):
    return pages.page_count(fixture(spark, sf, "pages"))


@query
def sort_pages(spark, sf):
    found = fixture(spark, sf, "f_docs_urls").withColumn("host", U.url_netloc("url"))
    return pages.sort_pages(found, "host")


@query
def url_list(spark, sf):
    found = crawl.crawl(fixture(spark, sf, "f_links"), _site_seeds(spark, sf), depth=2, max_pages=20)
    urls = fixture(spark, sf, "pages").select(F.col("page_id").alias("node"), "url")
    return pages.url_list(found.join(urls, "node"))


@query
def key_collisions(spark, sf):
    return pages.key_collisions(fixture(spark, sf, "pages"))


@query
def last_wins(spark, sf):
    keyed = fixture(spark, sf, "pages").select(
        "page_id", "url", U.url_netloc("url").alias("host"), U.page_key("url").alias("key")
    )
    return last_per_group(keyed, ["host", "key"], "page_id")


@query
def last_wins_repeated(spark, sf):
    """The last page of each site and depth of address, with equal rows and rows without a site."""
    rows = fixture(spark, sf, "f_sites").select("page_id", F.when(~F.col("site").endswith(".net"), F.col("site")).alias("site"), F.size(F.split("url", "/")).alias("deep"))
    return last_per_group(rows.unionByName(rows), ["site", "deep"], "page_id")


@query
def fetch_found(spark, sf):
    found = crawl.crawl(fixture(spark, sf, "f_links"), _site_seeds(spark, sf), depth=2, max_pages=20)
    at_hand = fixture(spark, sf, "pages").join(fixture(spark, sf, "f_existing").select("page_id"), "page_id", "left_anti")
    return pages.fetch_found(found, at_hand).select("page_id", "url", F.length("html").alias("n_chars"), "fetched")


# --- sinks, read back ----------------------------------------------------------------


@query
def ingest_documents(spark, sf):
    path = fresh_path(spark, "ingested")
    tables.ingest_documents(_ingested(spark, sf), path, "full_name")
    return tables.read_table(spark, path).select("doc_id", "full_name", "status", F.length("content").alias("n_chars"))


@query
def save_pages(spark, sf):
    """All pages stored, then those of one domain again: nothing is lost or doubled."""
    path, all_pages = fresh_path(spark, "pages"), fixture(spark, sf, "pages")
    tables.save_pages(all_pages, path)
    tables.save_pages(all_pages.filter(F.contains("url", F.lit(".com"))), path)
    return tables.read_table(spark, path).select("page_id", "host", "key", F.length("html").alias("n_chars"))


@query
def save_pages_parity(spark, sf):
    path, all_pages = fresh_path(spark, "pages"), fixture(spark, sf, "pages")
    tables.save_pages(all_pages, path, parity=True)
    return tables.read_table(spark, path).select("page_id", "host", "key")


@query
def write_manifest(spark, sf):
    path = fresh_path(spark, "manifest")
    found = fixture(spark, sf, "f_docs_urls").withColumn("host", U.url_netloc("url"))
    seeds = first_per_group(found, ["host"], "page_id")
    manifest.write_manifest(found, seeds, path)
    return spark.read.text(path).select("host", F.col("value").alias("line"))


@query
def merge_manifest(spark, sf):
    """Manifests in three runs: some pages, pages of other hosts, then all pages again."""
    path = fresh_path(spark, "manifests")
    found = fixture(spark, sf, "f_docs_urls").withColumn("host", U.url_netloc("url"))
    seeds = first_per_group(found, ["host"], "page_id")
    part = F.pmod(F.xxhash64("url"), F.lit(3))
    manifest.merge_manifest(found.filter(part == 0), seeds.filter(F.col("host").startswith("blog")), path, parts=16)
    manifest.merge_manifest(found.filter(part == 1).filter(~F.col("host").startswith("blog")), seeds, path, parts=8)
    manifest.merge_manifest(found, seeds, path)
    return tables.read_table(spark, path).select("host", F.col("line_no").cast("bigint"), "line")


@query
def upsert_repeated(spark, sf):
    """The same pages stored with other numbers of folders, with repeated rows and rows without a key."""
    path = fresh_path(spark, "pages")
    rows = fixture(spark, sf, "f_sites").select("page_id", "url", F.when(F.col("host") != "", F.col("site")).alias("host"))
    rows = rows.withColumn("host", F.when(~F.col("host").endswith(".org"), F.col("host")))
    once = last_per_group(rows.unionByName(rows), ["host", "url"], "page_id")
    tables.upsert(once, path, "host", ["host", "url"], parts=16)
    tables.upsert(once, path, "host", ["host", "url"], parts=64)
    tables.upsert(once.filter("page_id % 2 = 0"), path, "host", ["host", "url"])
    return tables.read_table(spark, path).select("page_id", "host", "url")


@query
def write_if_absent(spark, sf):
    """Pages of an earlier run stay as they were; the rest is added, once."""
    path = fresh_path(spark, "pages")
    stored = fixture(spark, sf, "f_existing").withColumn("origin", F.lit("earlier"))
    new = fixture(spark, sf, "pages").select("page_id", "url").withColumn("origin", F.lit("new"))
    tables.write_if_absent(stored, path, "url", ["url"], "page_id")
    tables.write_if_absent(new, path, "url", ["url"], "page_id")
    tables.write_if_absent(new, path, "url", ["url"], "page_id")
    return tables.read_table(spark, path).select("page_id", "url", "origin")


@query
def replace_repo(spark, sf):
    """Repositories fetched again with half their files: older files go, others stay."""
    path = fresh_path(spark, "repos")
    stored = fixture(spark, sf, "f_files").select("full_name", F.concat_ws("/", "dir", "file").alias("path"), "supported")
    tables.replace_repo(stored.withColumn("version", F.lit(1)), path)
    again = stored.filter("supported").withColumn("version", F.lit(2))
    tables.replace_repo(again, path)
    return tables.read_table(spark, path).select("full_name", "path", "version")


@query
def replace_repo_merge(spark, sf):
    path = fresh_path(spark, "repos")
    stored = fixture(spark, sf, "f_files").select("full_name", F.concat_ws("/", "dir", "file").alias("path"), "supported")
    tables.replace_repo(stored.withColumn("version", F.lit(1)), path)
    tables.replace_repo(stored.filter("supported").withColumn("version", F.lit(2)), path, merge=True)
    return tables.read_table(spark, path).select("full_name", "path", "version")


# --- streams -----------------------------------------------------------------------


def _stored_files(spark, sf) -> FileStore:
    """Repositories stored, those with supported files fetched again twice, others given more files."""
    store = FileStore(spark, fresh_path(spark, "store"))
    files = fixture(spark, sf, "f_files").select(
        "full_name", F.concat_ws("/", "dir", "file").alias("path"), F.col("content").cast("binary").alias("content"), "supported"
    )
    # written once, as each store reads them again
    files = stage(files, "given_files")
    again = files.filter("supported")
    again = again.withColumn("content", F.when(F.col("path").contains("/src/"), F.concat("content", F.lit("\n2").cast("binary"))).otherwise(F.col("content")))
    mirrored = files.filter("not supported").withColumn("path", F.concat("path", F.lit(".copy")))
    store.write(files)
    store.write(again)
    store.write(again)
    store.write(mirrored, merge=True)
    store.compact()
    return store


@query
def file_store(spark, sf):
    """Files as they are read back after all writes."""
    return _stored_files(spark, sf).read().select("full_name", "path", F.sha2("content", 256).alias("digest"), F.length("content").alias("n_bytes"))


@query
def file_store_contents(spark, sf):
    """Each content is stored once, and those that no file names are swept."""
    store = _stored_files(spark, sf)
    store.sweep()
    stored = store.contents().groupBy("digest").agg(F.count(F.lit(1)).alias("n_stored"))
    named = store.files().groupBy("digest").agg(F.count(F.lit(1)).alias("n_files"))
    return stored.join(named, "digest", "left").select("digest", "n_stored", "n_files")


def _message_files(spark, sf) -> str:
    folder = fresh_path(spark, "messages")
    fixture(spark, sf, "f_messages").select("msg_id", "msg").repartition(6, "msg_id").write.parquet(folder)
    return folder


@query
def route_stream(spark, sf):
    out = fresh_path(spark, "routed")
    messages = streams.message_stream(spark, _message_files(spark, sf), files_per_batch=2)
    streams.route_stream(messages, out, fresh_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out)


@query
def seen_stream(spark, sf):
    out = fresh_path(spark, "seen")
    messages = streams.message_stream(spark, _message_files(spark, sf), files_per_batch=2)
    streams.seen_stream(messages, out, fresh_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).select("cmd", "arg")


@query
def requests_seen_lately(spark, sf):
    """Requests after a silence of two days, from deliveries out of order with repeats and restarts."""
    folder, out, checkpoint = (fresh_path(spark, name) for name in ("timed", "seen_lately", "offsets"))
    sent = fixture(spark, sf, "f_timed_messages").withColumn("sent_at", F.col("sent_at").cast("timestamp"))
    # a message is up to two days under way, so a delivery holds messages older than some before it
    arrival = F.dayofmonth("sent_at") + F.pmod(F.xxhash64("msg_id"), F.lit(3))
    late = sent.withColumn("delivery", F.when(arrival <= 11, 0).when(arrival <= 22, 1).otherwise(2))
    again = late.filter(F.pmod(F.xxhash64("msg"), F.lit(4)) == 0).withColumn("delivery", F.least(F.col("delivery") + 1, F.lit(2)))
    delivered = stage(late.unionByName(again), "deliveries")
    # time goes on when the last request has been made
    end = sent.agg((F.max("sent_at") + F.expr("interval 30 days")).alias("sent_at")).select(F.lit("end").alias("msg_id"), F.lit("").alias("msg"), "sent_at")
    for number in range(3):
        part = delivered.filter(F.col("delivery") == number).select("msg_id", "msg", "sent_at")
        (part.unionByName(end) if number == 2 else part).coalesce(4).write.mode("append").parquet(folder)
        seen = streams.requests_seen_lately(spark, folder, "2 days", "15 days")
        write_seen(seen, out, checkpoint).awaitTermination()
    at = F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_seen")
    return spark.read.schema("cmd string, arg string, first_id string, first_seen timestamp").parquet(out).select("cmd", "arg", "first_id", at)


# --- whole flows ---------------------------------------------------------------------


def _code_run(spark, sf):
    return get_code(
        read_requests(fixture(spark, sf, "f_messages"), ["msg_id"]).withColumnRenamed("msg_id", "req_id"),
        fixture(spark, sf, "f_run_settings"),
        fixture(spark, sf, "f_catalog"),
        fixture(spark, sf, "f_branches"),
        fixture(spark, sf, "f_default_branches"),
        fixture(spark, sf, "f_files").drop("root"),
        fixture(spark, sf, "f_raw_available"),
        "/data/repos",
    )


@query
def get_code_status(spark, sf):
    return _code_run(spark, sf).status


@query
def get_code_lists(spark, sf):
    return _code_run(spark, sf).lists()


@query
def get_code_log(spark, sf):
    path = fresh_path(spark, "log")
    run_log.write_run_log(_code_run(spark, sf).log, path)
    return spark.read.parquet(path)


def _zip_repository(key: tuple, files: pd.DataFrame) -> pd.DataFrame:
    """An archive of a repository's files, or something else where its state is bad; a missing text is an empty file."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for entry, content in zip(files["entry"], files["content"]):
            archive.writestr(entry, "" if pd.isna(content) else content)
    content = buffer.getvalue() if key[1] == "good" else b"no archive"
    return pd.DataFrame({"full_name": [key[0]], "content": [content]})


def _save_repositories(spark, sf, folder: str) -> None:
    """Archives ``folder/owner/name.zip`` of all repositories whose archive is not missing; the folder is there without any."""
    store, inner = open_store(folder)
    store.create_dir(inner, recursive=True)
    entry = F.concat(F.substring(F.col("dir"), F.length("root") + 2, F.lit(1 << 20)), F.lit("/"), "file")
    files_ = fixture(spark, sf, "f_files").join(fixture(spark, sf, "f_archive_state").filter("state <> 'missing'"), "full_name")
    packed = files_.select("full_name", "state", entry.alias("entry"), "content").groupBy("full_name", "state").applyInPandas(_zip_repository, "full_name string, content binary")

    def save(batches):
        for batch in batches:
            for name, content in zip(batch["full_name"], batch["content"]):
                store, path = open_store(f"{folder}/{name}.zip")
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    packed.mapInPandas(save, "n bigint").agg(F.sum("n")).collect()


def _answered_run(spark, sf):
    folder = fresh_path(spark, "fetched")
    _save_repositories(spark, sf, folder)
    formats.register_formats(spark)
    unpacked = spark.read.format("archives").option("path", folder).load()
    name = F.regexp_extract("path", "([^/]+/[^/]+)[.]zip$", 1).alias("full_name")
    below = F.regexp_extract(F.substring(F.col("dir"), F.length("root") + 2, F.lit(1 << 20)), "^[^/]*/?(.*)$", 1)
    trees_ = fixture(spark, sf, "f_files").select("full_name", F.concat_ws("/", F.nullif(below, F.lit("")), "file").alias("path"), F.col("content").cast("binary"))
    return get_code_answered(
        read_requests(fixture(spark, sf, "f_messages"), ["msg_id"]).withColumnRenamed("msg_id", "req_id"),
        fixture(spark, sf, "f_run_settings"),
        fixture(spark, sf, "f_answers"),
        # without the last candidate some repositories have no branch to fetch
        fixture(spark, sf, "f_branches").filter("branch <> 'latest'"),
        fixture(spark, sf, "f_default_branches"),
        unpacked.select(name, "entry", "piece", "content", "problem"),
        trees_,
        fixture(spark, sf, "f_raw_available"),
        "/data/repos",
    )


@query
def get_code_answered_status(spark, sf):
    return _answered_run(spark, sf).status


@query
def get_code_ingested(spark, sf):
    """Files that two equal runs have stored in place of each other."""
    out, run = fresh_path(spark, "code"), _answered_run(spark, sf)
    run.write(out)
    run.write(out)
    stored = tables.read_table(spark, f"{out}/repos")
    return stored.select("full_name", "fetch_mode", "branch", F.concat_ws("/", "dir", "file").alias("path"), "status", F.sha2("content", 256).alias("digest"))


def _docs_pages(spark, sf) -> DataFrame:
    """The pages as a written table, as a run reads them several times."""
    return stage(fixture(spark, sf, "f_docs"), "docs_pages")


def _docs_run(spark, sf):
    return get_docs(
        read_requests(fixture(spark, sf, "f_messages"), ["msg_id"]).withColumnRenamed("msg_id", "req_id"),
        fixture(spark, sf, "f_run_settings"),
        _docs_pages(spark, sf),
    )


@query
def get_docs_status(spark, sf):
    return _docs_run(spark, sf).status.drop("outcome")


def _odd_docs_run(spark, sf):
    """Requests of which some have no browser and some no host in their address."""
    requests = read_requests(fixture(spark, sf, "f_messages"), ["msg_id"]).withColumnRenamed("msg_id", "req_id")
    arg = F.when(F.col("req_id").endswith("3"), F.regexp_replace("arg", "^https://", "")).otherwise(F.col("arg"))
    some = F.regexp_extract("req_id", "^([0-9]+)-", 1).cast("int") % 4 == 0
    settings = fixture(spark, sf, "f_run_settings")
    for name in ("use_chrome", "use_firefox"):
        settings = settings.withColumn(name, F.when(some, F.lit(False)).otherwise(F.col(name)))
    return get_docs(requests.withColumn("arg", arg), settings, _docs_pages(spark, sf))


@query
def get_docs_outcomes(spark, sf):
    return _odd_docs_run(spark, sf).status.select("req_id", "url", "outcome", "n_found", "n_saved", "final_text")


@query
def get_docs_saved(spark, sf):
    """Pages that two equal runs have stored."""
    out, run = fresh_path(spark, "docs"), _docs_run(spark, sf)
    run.write(out)
    run.write(out)
    return tables.read_table(spark, f"{out}/pages").select("host", "key", "page_id", "url", F.length("html").alias("n_chars"))


@query
def get_docs_manifest(spark, sf):
    out = fresh_path(spark, "docs")
    _docs_run(spark, sf).write(out)
    return tables.read_table(spark, f"{out}/manifests").select("host", F.col("line_no").cast("bigint"), "line")


@query
def get_docs_ingested(spark, sf):
    out = fresh_path(spark, "docs")
    _docs_run(spark, sf).write(out)
    files = tables.read_table(spark, f"{out}/ingested")
    return files.select("full_name", "file", "status", F.sha2("content", 256).alias("digest"))


@query
def get_docs_found(spark, sf):
    return _docs_run(spark, sf).found


@query
def get_docs_pages(spark, sf):
    return _docs_run(spark, sf).pages.select("folder", "key", "page_id", "url", F.length("html").alias("n_chars"))


@query
def get_docs_log(spark, sf):
    return _docs_run(spark, sf).log


@query
def links_and_pages_per_host(spark, sf):
    """Distinct links and pages per host: one shuffle for the links, one for the counts."""
    source = fixture(spark, sf, "pages")
    by_host = links.extract_links(source).select(U.url_netloc("url").alias("host"), "abs_url").distinct()
    n_links = by_host.groupBy("host").agg(F.count(F.lit(1)).alias("n_links"))
    return pages.page_count(source).join(n_links, "host", "left").select(
        "host", F.col("n").alias("n_pages"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
    )
