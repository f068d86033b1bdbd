"""Code requests from the search's answers to stored files.

Unlike ``get_code``, which looks names up in a ready catalog, this flow starts with the
payload that the search gave each term, and ends with the content of the fetched files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions.requests import fetch_mode, finished_text, resolution_text, search_mode
from gleanwork.functions.urls import extraction_folder, repo_name
from gleanwork.model import CODE_COMMAND
from gleanwork.operators.files import attempt_count, first_branch, ingest_with_fallback, raw_urls
from gleanwork.operators.settings import resolve_settings
from gleanwork.operators.skew import first_per_group, join_present, key_load, split_join
from gleanwork.session import stage
from gleanwork.sinks.run_log import log_rows, write_run_log
from gleanwork.sinks.tables import ingest_documents, replace_groups
from gleanwork.sources.search import payload_status, read_search_api, read_search_raw

# Endings of files that are taken in as they are.
SUPPORTED = (".txt", ".md", ".rst", ".html", ".pdf", ".py", ".json")


@dataclass
class AnsweredRun:
    """Results of a batch of code requests."""

    status: DataFrame
    files: DataFrame
    log: DataFrame

    def write(self, out: str, parts: int | None = None) -> None:
        """Store files and log below ``out``: the attempts, and each repository in place of its earlier copy."""
        ingest_documents(self.files, f"{out}/ingested", "full_name", parts)
        replace_groups(self.files.filter("content is not null"), f"{out}/repos", "full_name", parts)
        write_run_log(self.log, f"{out}/log")


def search_outcomes(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """``q, search_mode, n_results, exact, full_name, html_url, status`` per term and mode of ``asked``.

    ``answers(q, mode, js)`` has the payload of a term in the shape of its mode; of several
    the smallest counts. The first result with the term as its name is taken alone, else all
    are. ``status`` is ``download`` for one result, ``list`` for many, else ``not_found``,
    ``empty`` (no payload) or ``bad_payload``.
    """
    terms = asked.select("q", F.col("search_mode").alias("mode")).distinct()
    one = first_per_group(answers.select("q", "mode", "js").filter("js is not null"), ["q", "mode"], "js")
    known = stage(terms.join(one, ["q", "mode"], "left"), "answers")
    raw, api = known.filter("mode = 'raw'"), known.filter("mode = 'api'")
    found = read_search_raw(raw, ["q", "mode"]).unionByName(read_search_api(api, ["q", "mode"]))
    same = F.col("full_name") == F.col("q")
    result = F.struct("pos", "full_name", "html_url")
    chosen = found.groupBy("q", "mode").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(same, result)).alias("_same"), F.min(result).alias("_first")
    )
    shape = F.when(F.col("mode") == "raw", payload_status("js", "raw")).otherwise(payload_status("js", "api"))
    per_term = known.select("q", "mode", shape.alias("_shape")).join(chosen, ["q", "mode"], "left")
    n = F.when(F.col("_same").isNotNull(), F.lit(1)).otherwise(F.coalesce("_n", F.lit(0))).cast("bigint")
    lone = F.coalesce(F.col("_same"), F.when(F.col("_n") == 1, F.col("_first")))
    return per_term.select(
        "q",
        F.col("mode").alias("search_mode"),
        n.alias("n_results"),
        F.col("_same").isNotNull().alias("exact"),
        lone["full_name"].alias("full_name"),
        lone["html_url"].alias("html_url"),
        F.when(n == 1, "download").when(n > 1, "list").when(F.col("_shape") == "ok", "not_found").otherwise(F.col("_shape")).alias("status"),
    )


def _placed(files: DataFrame, out: str, top: Column, entry: str) -> DataFrame:
    """Files with the folder they are unpacked to: ``root``, ``dir`` and ``file``."""
    folder = F.regexp_extract(entry, "^(.*)/[^/]*$", 1)
    return files.withColumns(
        {
            "root": extraction_folder(F.lit(out), "full_name"),
            "dir": F.concat_ws("/", extraction_folder(F.lit(out), "full_name"), F.nullif(top, F.lit("")), F.nullif(folder, F.lit(""))),
            "file": F.regexp_extract(entry, "([^/]*)$", 1),
        }
    )


def fetched_files(repos: DataFrame, archives: DataFrame, trees: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    """Files of ``repos(full_name, fetch_mode, branch)`` with content, and per repository what went wrong.

    ``archives(full_name, entry, piece, content, problem)`` as the ``archives`` source gives
    them, ``trees(full_name, path, content)`` for the api. A repository without an archive has
    the problem ``missing_archive``, one whose archive cannot be read ``bad_archive``.
    """
    wanted = repos.filter("branch is not null")
    zips, listed = wanted.filter("fetch_mode = 'zip'"), wanted.filter("fetch_mode = 'api'")
    in_zip = split_join(archives, zips, ["full_name"], ["entry"], key_load(archives, ["full_name"]))
    in_zip = stage(in_zip.select("full_name", "fetch_mode", "branch", "entry", "piece", "content", "problem"), "zip_files")
    seen = in_zip.groupBy("full_name").agg(F.max(F.col("problem") == "bad_archive").alias("_bad"))
    problem = F.when(F.col("_seen").isNull(), "missing_archive").when(F.col("_bad"), "bad_archive")
    problems = zips.join(seen.withColumn("_seen", F.lit(True)), "full_name", "left").select("full_name", "fetch_mode", problem.alias("problem")).filter("problem is not null")
    unpacked = _placed(in_zip.filter("entry is not null"), out, F.lit(""), "entry")
    from_api = split_join(trees, listed, ["full_name"], ["path"], key_load(trees, ["full_name"]))
    from_api = _placed(from_api, out, F.concat(repo_name("full_name"), F.lit("-"), "branch"), "path")
    from_api = from_api.withColumns({"piece": F.lit(0), "problem": F.lit(None).cast("string")})
    columns = ["full_name", "fetch_mode", "branch", "root", "dir", "file", "piece", "content", "problem"]
    return unpacked.select(columns).unionByName(from_api.select(columns)), problems


def get_code_answered(
    requests: DataFrame,
    settings: DataFrame,
    answers: DataFrame,
    branches: DataFrame,
    default_branches: DataFrame,
    archives: DataFrame,
    trees: DataFrame,
    raw_available: DataFrame,
    out: str,
    supported: tuple[str, ...] = SUPPORTED,
) -> AnsweredRun:
    """Answers to results, results to repositories, repositories to files, for all requests at once.

    ``requests(req_id, cmd, arg)``; ``settings(req_id, ...)``; ``answers`` as for
    ``search_outcomes``; ``branches`` and ``default_branches(full_name, branch)``;
    ``archives`` and ``trees`` as for ``fetched_files``; ``raw_available(raw_url)``. A
    repository is fetched once per mode, however many requests resolve to it. A file counts
    as failed if it is neither readable and of a supported ending nor there under its raw
    address.
    """
    asked = requests.filter(F.col("cmd") == CODE_COMMAND).select("req_id", F.col("arg").alias("q"))
    modes = [search_mode("github_api_key").alias("search_mode"), fetch_mode("github_api_key", "use_api").alias("fetch_mode")]
    asked = stage(resolve_settings(asked, settings).select("req_id", "q", *modes), "asked")
    outcomes = stage(search_outcomes(asked, answers), "outcomes")
    term = ["q", "search_mode"]
    downloads = stage(split_join(asked, outcomes, term, ["req_id"], key_load(asked, term), "left"), "downloads")
    by_zip = first_branch(branches).withColumnRenamed("branch", "_zip_branch")
    by_api = default_branches.select("full_name", F.col("branch").alias("_api_branch"))
    branch = F.when(F.col("fetch_mode") == "api", F.col("_api_branch")).otherwise(F.col("_zip_branch"))
    repos = downloads.filter("status = 'download'").select("full_name", "fetch_mode").distinct()
    repos = repos.join(by_zip, "full_name", "left").join(by_api, "full_name", "left")
    repos = stage(repos.select("full_name", "fetch_mode", branch.alias("branch")), "repos")
    files, problems = fetched_files(repos, archives, trees, out)
    ending = F.regexp_extract(F.lower("file"), "([.][^.]*)$", 1)
    files = files.withColumn("supported", F.col("content").isNotNull() & ending.isin(*supported))
    ingested = stage(ingest_with_fallback(raw_urls(files, "full_name", "branch"), raw_available), "ingested")
    repo = ["full_name", "fetch_mode"]
    counts = attempt_count(ingested.filter(F.coalesce("piece", F.lit(0)) == 0), repo)
    per_repo = repos.join(counts, repo, "left").join(problems, repo, "left")
    popular = key_load(downloads.filter("full_name is not null"), repo)
    joined = join_present(downloads, per_repo, repo, ["req_id"], popular)
    failed = F.when(F.col("branch").isNull(), "download_failed").otherwise(F.col("problem"))
    status = F.when(F.col("status") == "download", F.coalesce(failed, F.lit("download"))).otherwise(F.col("status"))
    rows = joined.select(
        "req_id",
        "q",
        "n_results",
        status.alias("status"),
        "exact",
        "full_name",
        *[c for c in ("search_mode", "fetch_mode", "branch")],
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("attempted", "local", "raw", "failed")],
        resolution_text("n_results", "q", "full_name", "html_url").alias("message"),
    )
    rows = stage(rows.withColumn("final_text", F.when(F.col("status") == "download", finished_text("attempted"))), "status")
    is_status, tried = F.col("status"), ["download", "download_failed", "missing_archive", "bad_archive"]
    problem = is_status.isin("download_failed", "missing_archive", "bad_archive")
    log = log_rows(
        rows,
        "req_id",
        [
            ("search_started", F.lit(True), F.lit(0)),
            ("search_failed", is_status.isin("empty", "bad_payload"), F.lit(0)),
            ("not_found", is_status == "not_found", F.lit(0)),
            ("listed", is_status == "list", F.col("n_results")),
            ("download_started", is_status.isin(*tried), F.lit(1)),
            ("download_failed", problem, F.lit(0)),
            ("ingest_started", is_status == "download", F.lit(0)),
            ("ingest_finished", is_status == "download", F.col("attempted")),
        ],
    )
    return AnsweredRun(rows, ingested, log)
