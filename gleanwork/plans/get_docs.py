"""Documentation requests from message to ingested pages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions.requests import finished_text, pick_profile
from gleanwork.functions.urls import page_digest, strip_fragment, url_host, url_netloc
from gleanwork.model import DOCS_COMMAND, TEXT_NO_BROWSER
from gleanwork.operators.crawl import crawl
from gleanwork.operators.links import link_edges
from gleanwork.operators.settings import resolve_settings
from gleanwork.operators.skew import ROWS_PER_TASK, key_load, split_join
from gleanwork.session import stage
from gleanwork.sinks.manifest import merge_manifest
from gleanwork.sinks.run_log import log_rows, write_run_log
from gleanwork.sinks.tables import ingest_documents, upsert


@dataclass
class DocsRun:
    """Results of a batch of documentation requests."""

    status: DataFrame
    found: DataFrame
    pages: DataFrame
    log: DataFrame
    # pages found per folder, and the addresses that crawls started from
    listed: DataFrame
    starts: DataFrame

    @cached_property
    def _stored(self) -> DataFrame:
        """The pages as a written table: their texts are looked up once for all that is stored."""
        return stage(self.pages, "saved")

    def write(self, out: str, parts: int | None = None) -> None:
        """Store pages, manifests, ingested files and the run log below ``out``.

        Pages and manifests of a second run take the place of equal ones; files and log are
        appended, as each run is an attempt of its own.
        """
        pages = self._stored.withColumnRenamed("folder", "host")
        upsert(pages, f"{out}/pages", "host", ["host", "key"], parts)
        merge_manifest(self.listed, self.starts, f"{out}/manifests", parts)
        # without a fallback address a page that is at hand is a local file
        files = self._stored.select(F.col("folder").alias("full_name"), F.concat("key", F.lit(".html")).alias("file"), F.col("html").alias("content"))
        ingest_documents(files.withColumn("status", F.lit("local")), f"{out}/ingested", "full_name", parts)
        write_run_log(self.log, f"{out}/log")


def reachable_edges(pages: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Links that lead to a page whose content is at hand: the others cannot be found."""
    edges = stage(link_edges(pages), "links")
    known = pages.select(strip_fragment("url").alias("dst")).distinct()
    load = key_load(edges, ["dst"], rows_per_task)
    return split_join(edges, known, ["dst"], ["src"], load, "left_semi")


def _outcome() -> Column:
    """What becomes of a request: ``no_browser``, ``crawl_failed`` (no host to stay on) or ``crawled``."""
    return F.when(F.col("browser").isNull(), "no_browser").when(url_host("url") == "", "crawl_failed").otherwise("crawled")


def get_docs(requests: DataFrame, settings: DataFrame, pages: DataFrame, include_seed: bool = True) -> DocsRun:
    """Crawl, fetch and ingest for all documentation requests.

    ``requests(req_id, cmd, arg)``; ``settings(req_id, ...)``; ``pages(page_id, url,
    html)``. Requests for the same address and limits share one crawl. The outcome of a
    request is ``crawled``, ``no_browser`` or ``crawl_failed``; only the first has counts.
    """
    asked = requests.filter(F.col("cmd") == DOCS_COMMAND).select("req_id", F.col("arg").alias("url"))
    limits = ["max_depth", "max_pages"]
    runs = stage(
        resolve_settings(asked, settings).select(
            "req_id",
            "url",
            strip_fragment("url").alias("node"),
            F.col("scraping_depth").alias("max_depth"),
            F.col("scraping_max_pages").alias("max_pages"),
            pick_profile("req_id", "use_chrome", "use_firefox", "use_webkit", strict=False).alias("browser"),
        ),
        "runs",
    )
    # a request without a browser or a host to stay on is not crawled
    crawls = (
        runs.filter(_outcome() == "crawled")
        .groupBy("node", *limits)
        .agg(F.min("req_id").alias("seed"))
        .withColumn("domain", url_host("node"))
    )
    bound = runs.agg(F.max("max_depth").alias("d"), F.max("max_pages").alias("p")).first()
    found = crawl(
        reachable_edges(pages), crawls, bound["d"] or 0, bound["p"] or 1, include_seed
    )
    # one copy of each page, in order of first appearance under its address
    kept = pages.groupBy(strip_fragment("url").alias("node")).agg(F.min("page_id").alias("page_id"))
    fetched = stage(
        split_join(found, kept, ["node"], ["seed"], key_load(found, ["node"]), "left").select(
            "seed", "node", "depth", "page_id"
        ),
        "fetched",
    )
    per_crawl = fetched.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n_found"),
        F.count("page_id").alias("n_saved"),
    )
    per_limits = crawls.select("seed", "node", *limits).join(per_crawl, "seed", "left")
    load = key_load(runs, ["node", *limits])
    status = split_join(runs, per_limits, ["node", *limits], ["req_id"], load, "left").select(
        "req_id",
        "url",
        url_netloc("url").alias("domain"),
        "seed",
        *limits,
        "browser",
        # the same address may have been crawled for another request
        *[F.when(_outcome() == "crawled", F.coalesce(n, F.lit(0))).otherwise(0).cast("bigint").alias(n) for n in ("n_found", "n_saved")],
        _outcome().alias("outcome"),
    ).withColumn("final_text", F.when(F.col("outcome") == "crawled", finished_text("n_saved")).when(F.col("outcome") == "no_browser", TEXT_NO_BROWSER))
    domains = crawls.select("seed", url_netloc("node").alias("folder"))
    # content moves once per folder and page, not once per crawl
    wanted = fetched.filter("page_id is not null").join(domains, "seed").select("folder", "page_id").distinct()
    saved = wanted.join(pages, "page_id").select(
        "folder", page_digest(strip_fragment("url")).alias("key"), "page_id", "url", "html"
    )
    crawled = F.col("outcome") == "crawled"
    log = log_rows(
        status,
        "req_id",
        [
            ("settings_read", F.lit(True), F.lit(0)),
            ("crawl_started", F.col("outcome") != "no_browser", F.lit(0)),
            ("no_browser", F.col("outcome") == "no_browser", F.lit(0)),
            ("crawl_failed", F.col("outcome") == "crawl_failed", F.lit(0)),
            ("crawl_ended", crawled, F.col("n_found")),
            ("pages_saved", crawled, F.col("n_saved")),
            ("ingest_started", crawled, F.lit(0)),
            ("ingest_finished", crawled, F.col("n_saved")),
        ],
    )
    listed = fetched.join(domains, "seed").select(F.col("folder").alias("host"), F.col("node").alias("url")).distinct()
    # of several starts on one host the smallest heads its manifest
    starts = crawls.groupBy(url_netloc("node").alias("host")).agg(F.min("node").alias("url"))
    return DocsRun(status, fetched.select("seed", "node", "depth"), saved, log, listed, starts)
