"""Addresses: hosts, repository and file URLs, storage paths, link resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanwork.model import ARCHIVE_PATH, RAW_FILE_URL, REPO_URL

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_NETLOC = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def url_netloc(url: Column | str) -> Column:
    """Network location with port and user part kept; ``''`` when there is none.

    A pattern and not ``parse_url``: addresses with blanks or stray characters
    must not raise or lose their host.
    """
    return F.coalesce(F.regexp_extract(F.trim(as_column(url)), _NETLOC, 1), F.lit(""))


def url_host(url: Column | str) -> Column:
    """Lower-case host name without user part and port."""
    without_user = F.regexp_replace(url_netloc(url), "^.*@", "")
    return F.lower(F.regexp_replace(without_user, ":[0-9]*$", ""))


def host_domains(host: Column | str) -> Column:
    """The host and every parent domain: ``a.b.c`` gives ``[a.b.c, b.c, c]``."""
    parts = F.split(as_column(host), "[.]")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )


def allowed_domain(host: Column | str, domain: Column | str) -> Column:
    """True when the host is the domain or one of its subdomains."""
    host, domain = as_column(host), as_column(domain)
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def strip_fragment(url: Column | str) -> Column:
    return F.regexp_replace(as_column(url), "#.*$", "")


def page_key(url: Column | str) -> Column:
    """The last but one piece between slashes; NULL when the text has no slash."""
    return F.try_element_at(F.split(as_column(url), "/"), F.lit(-2))


def page_digest(url: Column | str) -> Column:
    """A key that never merges two pages."""
    return F.sha2(as_column(url), 256)


def repo_owner(name: Column | str) -> Column:
    return F.element_at(F.split(as_column(name), "/"), 1)


def repo_name(name: Column | str) -> Column:
    return F.element_at(F.split(as_column(name), "/"), -1)


def repo_url(name: Column | str) -> Column:
    return F.concat(F.lit(REPO_URL), as_column(name))


def archive_url(name: Column | str, branch: Column | str) -> Column:
    return F.concat(repo_url(name), F.lit(ARCHIVE_PATH), as_column(branch), F.lit(".zip"))


def archive_path(out: Column | str, name: Column | str) -> Column:
    return F.concat(extraction_folder(out, name), F.lit(".zip"))


def extraction_folder(out: Column | str, name: Column | str) -> Column:
    return F.concat_ws("/", as_column(out), repo_owner(name), repo_name(name))


def relative_dir(directory: Column | str, root: Column | str) -> Column:
    """Folder below ``root`` without its first segment.

    With the extraction folder as root this drops the archive's top folder. With
    the output folder as root it drops just the owner.
    """
    below = F.substring(F.replace(as_column(directory), as_column(root), F.lit("")), 2, 1 << 30)
    return F.regexp_replace(below, "^[^/]*/?", "")


def raw_file_url(
    name: Column | str,
    branch: Column | str,
    relpath: Column | str,
    file: Column | str,
    parity: bool = False,
) -> Column:
    """Raw address of a file. ``parity`` keeps the double slash of an empty folder."""
    middle = as_column(relpath) if parity else F.nullif(as_column(relpath), F.lit(""))
    return F.concat(
        F.lit(RAW_FILE_URL),
        F.concat_ws("/", as_column(name), as_column(branch), middle, as_column(file)),
    )


def _join_segments(path: Column, rooted: bool) -> Column:
    """Resolve ``.`` and ``..``; a path joined to a folder also loses empty segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    segments = parts
    if not rooted:
        inner = F.filter(F.slice(parts, F.lit(2), F.size(parts) - 2), lambda s: s != "")
        segments = F.when(
            F.size(parts) > 2, F.concat(F.array(F.lit("")), inner, F.array(last))
        ).otherwise(parts)
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.array_append(done, s)),
    )
    closed = F.when(last.isin(".", ".."), F.array_append(folded, F.lit(""))).otherwise(folded)
    joined = F.array_join(closed, "/")
    # climbing above the root leaves no leading empty segment
    return F.when(joined == "", F.lit("/")).when(
        F.startswith(joined, F.lit("/")), joined
    ).otherwise(F.concat(F.lit("/"), joined))


def _clean_path(path: Column, rooted: bool) -> Column:
    # most links need no folding, so test with a pattern before the array work
    return F.when(path.rlike(r"(^|/)[.]{1,2}(/|$)|//"), _join_segments(path, rooted)).otherwise(path)


def base_parts(base: Column | str) -> Column:
    """The pieces of a page address that its links are completed with, as a struct."""
    base = as_column(base)
    scheme = F.regexp_extract(base, _SCHEME, 1)
    path = F.regexp_extract(base, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, "[^/]*$", "")
    return F.struct(
        scheme.alias("scheme"),
        F.concat(scheme, F.lit("://"), url_netloc(base)).alias("site"),
        path.alias("path"),
        F.when(folder == "", F.lit("/")).otherwise(folder).alias("folder"),
        strip_fragment(base).alias("bare"),
    )


def resolve_with(href: Column, base: Column) -> Column:
    """Absolute form of a link, given the ``base_parts`` of its page."""
    path = F.regexp_extract(href, "^([^?#]*)", 1)
    tail = F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    return (
        F.when(href == "", base["bare"])
        .when(F.startswith(href, F.lit("//")), F.concat(base["scheme"], F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(base["site"], _clean_path(path, True), tail))
        .when(F.startswith(href, F.lit("#")), F.concat(base["bare"], href))
        .when(F.startswith(href, F.lit("?")), F.concat(base["site"], base["path"], href))
        .when(href.rlike(_SCHEME), href)
        .otherwise(F.concat(base["site"], _clean_path(F.concat(base["folder"], path), False), tail))
    )


def resolve_href(href: Column | str, base: Column | str) -> Column:
    """Absolute form of a link found on the page ``base``."""
    return resolve_with(F.trim(as_column(href)), base_parts(base))
