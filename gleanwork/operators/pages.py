"""Pages per host: keys, collisions, counts, sorted lists, fetched content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.functions.urls import page_digest, page_key, url_netloc
from gleanwork.operators.skew import last_per_group, number_rows


def keyed_pages(pages: DataFrame, parity: bool = False) -> DataFrame:
    """Pages with host and storage key, one row per (host, key), the last one.

    The default key keeps all pages apart; ``parity`` takes the short key under
    which pages of one folder replace each other.
    """
    if not parity:
        keyed = pages.withColumn("host", url_netloc("url")).withColumn("key", page_digest("url"))
    else:
        keyed = pages.withColumn("host", url_netloc("url")).withColumn("key", page_key("url"))
    return last_per_group(keyed.filter("key is not null"), ["host", "key"], "page_id")


def key_collisions(pages: DataFrame) -> DataFrame:
    """Pages lost under the short key: ``host, key, n_lost, kept_page``."""
    return (
        pages.select("page_id", url_netloc("url").alias("host"), page_key("url").alias("key"))
        .filter("key is not null")
        .groupBy("host", "key")
        .agg((F.count(F.lit(1)) - 1).alias("n_lost"), F.max("page_id").alias("kept_page"))
        .filter("n_lost > 0")
    )


def page_count(pages: DataFrame) -> DataFrame:
    """Distinct pages per host."""
    # distinct first, so that the count itself is combined before its shuffle
    return (
        pages.select(url_netloc("url").alias("host"), "url")
        .distinct()
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sort_pages(found: DataFrame, group: str, url: str = "url") -> DataFrame:
    """Distinct addresses per group in order: ``group, line_no, url``."""
    return number_rows(found.select(group, url).distinct(), [group], [url], "line_no")


def url_list(found: DataFrame, group: str = "seed", url: str = "url") -> DataFrame:
    """Found addresses of each limited crawl as one text, a line per address.

    Meant for crawls with a page limit, which bounds the text; for whole hosts use
    ``sort_pages`` or ``write_manifest``.
    """
    return found.groupBy(group).agg(
        F.array_join(F.array_sort(F.collect_set(url)), "\n").alias("urls"),
        F.count_distinct(url).alias("n"),
    )


def fetch_found(found: DataFrame, pages: DataFrame, node: str = "node", key: str = "page_id") -> DataFrame:
    """Content of every found page, each page once; ``fetched`` tells if it was there.

    Crawls that found the same page share one copy, so its text moves once.
    """
    wanted = found.select(F.col(node).alias(key)).distinct()
    return wanted.join(pages.withColumn("fetched", F.lit(True)), key, "left").withColumn(
        "fetched", F.coalesce("fetched", F.lit(False))
    )
