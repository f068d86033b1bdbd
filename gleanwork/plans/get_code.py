"""Code requests from message to ingested files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.functions.requests import fetch_mode, finished_text, search_mode
from gleanwork.functions.urls import archive_path, archive_url, extraction_folder
from gleanwork.model import CODE_COMMAND
from gleanwork.operators.catalog import numbered_list, request_status, term_results
from gleanwork.operators.files import attempt_count, first_branch, ingest_with_fallback, raw_urls
from gleanwork.operators.settings import resolve_settings
from gleanwork.operators.skew import join_present, key_load, split_join
from gleanwork.session import stage
from gleanwork.sinks.run_log import log_rows


@dataclass
class CodeRun:
    """Results of a batch of code requests."""

    status: DataFrame
    files: DataFrame
    log: DataFrame
    asked: DataFrame
    catalog: DataFrame
    results: DataFrame

    def lists(self) -> DataFrame:
        """The lines of the lists that requests with several results get."""
        return numbered_list(self.asked, self.catalog, self.results)


def get_code(
    requests: DataFrame,
    settings: DataFrame,
    catalog: DataFrame,
    branches: DataFrame,
    default_branches: DataFrame,
    files: DataFrame,
    raw_available: DataFrame,
    out: str,
) -> CodeRun:
    """Resolve, choose branch and source, ingest: one result set for all requests.

    ``requests(req_id, cmd, arg)``; ``settings(req_id, ...)``; ``catalog(rank,
    full_name, html_url)``; ``branches`` and ``default_branches(full_name, branch)``;
    ``files(full_name, dir, file, supported)``. A repository is ingested once per
    branch, however many requests resolve to it.
    """
    asked = stage(
        requests.filter(F.col("cmd") == CODE_COMMAND).select("req_id", F.col("arg").alias("q")), "asked"
    )
    chosen = resolve_settings(asked.select("req_id"), settings).select(
        "req_id",
        search_mode("github_api_key").alias("search_mode"),
        fetch_mode("github_api_key", "use_api").alias("fetch_mode"),
    )
    results = term_results(asked, catalog)
    outcome = request_status(asked, catalog, results).join(chosen, "req_id")
    by_zip = first_branch(branches).withColumnRenamed("branch", "_zip_branch")
    by_api = default_branches.select("full_name", F.col("branch").alias("_api_branch"))
    # per repository and mode first, then back to the requests
    downloads = stage(outcome, "outcome")
    repos = (
        downloads.filter("status = 'download'")
        .select("full_name", "fetch_mode")
        .distinct()
        .join(by_zip, "full_name", "left")
        .join(by_api, "full_name", "left")
        .select(
            "full_name",
            "fetch_mode",
            F.when(F.col("fetch_mode") == "api", F.col("_api_branch"))
            .otherwise(F.col("_zip_branch"))
            .alias("branch"),
        )
    )
    fetched = repos.filter("branch is not null").select("full_name", "branch").distinct()
    big_repos = key_load(files, ["full_name"])
    fetched_files = split_join(files, fetched, ["full_name"], ["dir", "file"], big_repos)
    found = raw_urls(
        fetched_files.withColumn("root", extraction_folder(F.lit(out), "full_name")), "full_name", "branch"
    )
    ingested = stage(ingest_with_fallback(found, raw_available), "ingested")
    counts = attempt_count(ingested, ["full_name", "branch"])
    per_repo = join_present(repos, counts, ["full_name", "branch"], ["fetch_mode"])
    target = ["full_name", "fetch_mode"]
    popular = key_load(downloads.filter("full_name is not null"), target)
    status = stage(
        join_present(downloads, per_repo, target, ["req_id"], popular).select(
            "req_id",
            "q",
            "n_results",
            F.when((F.col("status") == "download") & F.col("branch").isNull(), "download_failed")
            .otherwise(F.col("status"))
            .alias("status"),
            "exact",
            "full_name",
            "search_mode",
            "fetch_mode",
            "branch",
            F.when(F.col("fetch_mode") == "zip", archive_url("full_name", "branch")).alias("archive_url"),
            F.when(F.col("branch").isNotNull(), archive_path(F.lit(out), "full_name")).alias("archive_path"),
            *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("attempted", "local", "raw", "failed")],
            "message",
        ),
        "status",
    ).withColumn(
        "final_text", F.when(F.col("status") == "download", finished_text("attempted"))
    )
    is_status = F.col("status")
    fetched_ok = is_status == "download"
    log = log_rows(
        status,
        "req_id",
        [
            ("search_started", F.lit(True), F.lit(0)),
            ("not_found", is_status == "not_found", F.lit(0)),
            ("listed", is_status == "list", F.col("n_results")),
            ("download_started", is_status.isin("download", "download_failed"), F.lit(1)),
            ("download_failed", is_status == "download_failed", F.lit(0)),
            ("ingest_started", fetched_ok, F.lit(0)),
            ("ingest_finished", fetched_ok, F.col("attempted")),
        ],
    )
    return CodeRun(status, ingested, log, asked, catalog, results)
