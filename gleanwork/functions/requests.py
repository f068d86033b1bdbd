"""Commands, settings and outcome texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanwork.functions.urls import as_column
from gleanwork.model import (
    CODE_COMMAND,
    DOCS_COMMAND,
    TEXT_DONE,
    TEXT_DOWNLOAD,
    TEXT_LIST,
    TEXT_NO_BROWSER,
    TEXT_NOT_FOUND,
    TRUE_SPELLINGS,
)

# the longer word comes first, else it would be read as the shorter one
_COMMAND = rf"(?s)^@({DOCS_COMMAND}|{CODE_COMMAND})\s+(.*)$"


def strip_blank(text: Column | str) -> Column:
    """Both ends without white space of any kind."""
    return F.regexp_replace(as_column(text), r"^\s+|\s+$", "")


def route_command(msg: Column | str) -> Column:
    """Command word of a message, NULL for plain chat."""
    return F.nullif(F.regexp_extract(as_column(msg), _COMMAND, 1), F.lit(""))


def command_argument(msg: Column | str) -> Column:
    """Text after the command word, without surrounding blanks."""
    return strip_blank(F.regexp_extract(as_column(msg), _COMMAND, 2))


def strip_highlight(name: Column | str) -> Column:
    """Search result name without highlight marks; only the slash entity is decoded."""
    plain = F.replace(F.replace(as_column(name), F.lit("<em>"), F.lit("")), F.lit("</em>"), F.lit(""))
    return F.replace(plain, F.lit("&#x2F;"), F.lit("/"))


def to_flag(value: Column | str) -> Column:
    """True for the accepted spellings of true, false for all else, NULL included."""
    return F.coalesce(as_column(value).cast("string").isin(*TRUE_SPELLINGS), F.lit(False))


def setting_flag(value: Column | str, default: bool) -> Column:
    return F.coalesce(as_column(value), F.lit(default))


def has_key(key: Column | str) -> Column:
    """True unless the access key is missing or blank."""
    return F.coalesce(strip_blank(key), F.lit("")) != ""


def search_mode(key: Column | str) -> Column:
    """Shape of the search payload: ``raw`` without a key, else ``api``."""
    return F.when(has_key(key), "api").otherwise("raw")


def fetch_mode(key: Column | str, use_api: Column | str, parity: bool = False) -> Column:
    """``api`` when a key is present and wanted, else ``zip``.

    ``parity`` takes a blank key as present, which the search does not.
    """
    present = as_column(key).isNotNull() if parity else has_key(key)
    return F.when(present & F.coalesce(as_column(use_api), F.lit(False)), "api").otherwise("zip")


def pick_profile(
    run_id: Column | str,
    use_chrome: Column | str,
    use_firefox: Column | str,
    use_webkit: Column | str,
    strict: bool = True,
) -> Column:
    """One enabled browser per run, chosen by a digest of the run so that reruns agree.

    With none enabled the query fails, or gives NULL when ``strict`` is off.
    """
    enabled = F.filter(
        F.array(
            F.when(as_column(use_chrome), "chromium"),
            F.when(as_column(use_firefox), "firefox"),
            F.when(as_column(use_webkit), "webkit"),
        ),
        lambda name: name.isNotNull(),
    )
    digest = F.conv(F.substring(F.md5(as_column(run_id).cast("string")), 1, 8), 16, 10).cast("bigint")
    # an empty list makes the index 1 out of range, which try_element_at turns into NULL
    index = (F.pmod(digest, F.greatest(F.size(enabled), F.lit(1)).cast("bigint")) + 1).cast("int")
    none = F.raise_error(F.lit(TEXT_NO_BROWSER)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(F.size(enabled) == 0, none).otherwise(F.try_element_at(enabled, index))


def resolution_kind(n_results: Column | str) -> Column:
    n = F.coalesce(as_column(n_results), F.lit(0))
    return F.when(n == 0, "not_found").when(n == 1, "download").otherwise("list")


def resolution_text(
    n_results: Column | str, q: Column | str, name: Column | str, url: Column | str
) -> Column:
    """What the user is told: nothing found, downloading, or the lead of a list."""
    kind = resolution_kind(n_results)
    return (
        F.when(kind == "not_found", F.concat(F.lit(TEXT_NOT_FOUND), as_column(q)))
        .when(
            kind == "download",
            F.concat(F.lit(TEXT_DOWNLOAD + " "), as_column(name), F.lit(" "), as_column(url)),
        )
        .otherwise(F.lit(TEXT_LIST))
    )


def finished_text(n_attempted: Column | str) -> Column:
    return F.format_string(TEXT_DONE, as_column(n_attempted))
