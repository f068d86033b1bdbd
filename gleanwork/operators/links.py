"""Links of HTML pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions.html import page_links
from gleanwork.functions.urls import base_parts, resolve_href, resolve_with, strip_fragment, url_host

# Comments, scripts and styles are matched first and so swallowed; only the last
# form, an anchor or area tag, fills the group. All forms share their first
# character, which lets the matcher run past plain text.
_ANCHORS = (
    r"<(?:!--(?s:.*?)-->|(?i:script)\b(?s:.*?)</(?i:script)\s*>|(?i:style)\b(?s:.*?)</(?i:style)\s*>"
    r"""|[aA](?:[rR][eE][aA])?\s(?:[^>]*?\s)?(?i:href)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))"""
)
_BASE = r"""<(?i:base)\s(?:[^>]*?\s)?(?i:href)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _attribute_value(raw: Column) -> Column:
    """Attribute text without quotes and blanks; ``&amp;`` is the entity that addresses need."""
    bare = F.regexp_replace(raw, r"^[\"']?\s*|\s*[\"']?$", "")
    return F.replace(bare, F.lit("&amp;"), F.lit("&"))


def hrefs(html: str) -> Column:
    """Distinct link texts of a page, in order of first appearance."""
    found = F.regexp_extract_all(html, F.lit(_ANCHORS), F.lit(1))
    return F.transform(F.array_distinct(F.filter(found, lambda raw: raw != "")), _attribute_value)


def _once(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with ``value`` computed once, however often it is used.

    The optimizer merges projections, so a pattern over a whole page that is named
    in several places would otherwise run in each of them.
    """
    return F.element_at(F.transform(F.array(value), make), 1)


def link_base(html: str, url: str) -> Column:
    """Parts of the address that links start from: the page's own or its base element's."""

    def address(raw: Column) -> Column:
        return F.when(raw == "", F.col(url)).otherwise(resolve_href(_attribute_value(raw), url))

    found = F.coalesce(F.regexp_extract(html, _BASE, 1), F.lit(""))
    return _once(found, lambda raw: _once(address(raw), base_parts))


def extract_links(pages: DataFrame, keep_fragment: bool = True) -> DataFrame:
    """Web links of ``pages(page_id, url, html)``, each address once per page.

    A page is one row, so links are made unique inside the row, without a shuffle.
    The page address is taken apart once per page, not once per link.
    """
    found = pages.select("page_id", "url", link_base("html", "url").alias("_base"), hrefs("html").alias("_hrefs"))
    resolved = F.transform("_hrefs", lambda h: resolve_with(h, F.col("_base")))
    if not keep_fragment:
        resolved = F.transform(resolved, strip_fragment)
    web = F.filter(F.array_distinct(resolved), lambda u: u.rlike("^(?i)https?://[^/?#]"))
    return found.select("page_id", "url", F.explode(web).alias("abs_url"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [page_links(page) for page in batch.column(2).to_pylist()]
        columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["page_id", "url", "_given", "_hrefs"])


def scanned_links(pages: DataFrame, keep_fragment: bool = True) -> DataFrame:
    """Like ``extract_links``, with a scanner in place of patterns.

    The scanner follows the rules for HTML where patterns give up: ``>`` inside attribute
    values, open quotes and comments, elements whose content is text, all character
    references. Pages go to Python in Arrow batches and only their links come back; links
    are resolved as before. Links in ``noscript`` and ``template`` count. A page without
    text or address has no links.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    given = pages.filter(F.col("url").isNotNull() & F.col("html").isNotNull()).select("page_id", "url", "html")
    found = given.mapInArrow(_scan, f"page_id {kind}, url string, _given string, _hrefs array<string>")
    address = F.when(F.col("_given").isNull(), F.col("url")).otherwise(resolve_href("_given", "url"))
    based = found.select("page_id", "url", _once(address, base_parts).alias("_base"), "_hrefs")
    resolved = F.transform("_hrefs", lambda h: resolve_with(h, F.col("_base")))
    if not keep_fragment:
        resolved = F.transform(resolved, strip_fragment)
    web = F.filter(F.array_distinct(resolved), lambda u: u.rlike("^(?i)https?://[^/?#]"))
    return based.select("page_id", "url", F.explode(web).alias("abs_url"))


def link_edges(pages: DataFrame, scanned: bool = False) -> DataFrame:
    """Edges ``src, dst, host`` between addresses without fragments, for ``crawl``.

    ``scanned`` takes the links from the scanner, which costs Python time, else from patterns.
    """
    links = (scanned_links if scanned else extract_links)(pages, keep_fragment=False)
    return links.select(
        strip_fragment("url").alias("src"), F.col("abs_url").alias("dst"), url_host("abs_url").alias("host")
    )
