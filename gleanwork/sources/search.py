"""Search payloads as ranked result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions.requests import strip_highlight
from gleanwork.functions.urls import repo_url
from gleanwork.model import API_SEARCH_SCHEMA, RAW_SEARCH_SCHEMA


def _raw_results(js: str) -> Column:
    return F.from_json(js, RAW_SEARCH_SCHEMA)["payload"]["results"]


def _api_results(js: str) -> Column:
    return F.from_json(js, API_SEARCH_SCHEMA)["items"]


def _well_formed(mode: str, results: Column) -> Column:
    """All results carry their fields; one bad result spoils the payload."""
    if mode == "raw":
        return F.forall(results, lambda r: r["hl_name"].isNotNull())
    return F.forall(results, lambda r: r["full_name"].isNotNull() & r["html_url"].isNotNull())


def payload_status(js: str, mode: str) -> Column:
    """``ok``, ``empty`` (no payload: the search failed) or ``bad_payload`` (wrong shape)."""
    results = _raw_results(js) if mode == "raw" else _api_results(js)
    return (
        F.when(F.coalesce(F.trim(js), F.lit("")) == "", "empty")
        .when(F.coalesce(_well_formed(mode, results), F.lit(False)), "ok")
        .otherwise("bad_payload")
    )


def read_search_raw(payloads: DataFrame, keys: list[str], js: str = "js") -> DataFrame:
    """Web search payloads to ``keys, pos, full_name, html_url`` in result order."""
    return (
        payloads.select(*keys, _raw_results(js).alias("_results"))
        .filter(_well_formed("raw", F.col("_results")))
        .select(*keys, F.posexplode("_results").alias("pos", "_result"))
        .select(*keys, "pos", strip_highlight("_result.hl_name").alias("full_name"))
        .withColumn("html_url", repo_url("full_name"))
    )


def read_search_api(payloads: DataFrame, keys: list[str], js: str = "js") -> DataFrame:
    """API search payloads to ``keys, pos, full_name, html_url`` in result order."""
    return (
        payloads.select(*keys, _api_results(js).alias("_results"))
        .filter(_well_formed("api", F.col("_results")))
        .select(*keys, F.posexplode("_results").alias("pos", "_result"))
        .select(*keys, "pos", "_result.full_name", "_result.html_url")
    )
