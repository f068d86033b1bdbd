"""Column functions on shapes that the test tables lack."""

from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from gleanwork.functions import requests as R
from gleanwork.functions import urls as U


def column(spark, values, make, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r["o"] for r in rows.select("i", make("v").alias("o")).orderBy("i").collect()]


URLS = [
    "https://h.org/a/b",
    "https://h.org",
    "https://h.org:8080/x",
    "http://me:pw@h.org/x?y=//z",
    "//h.org/x",
    "/only/path",
    "h.org/x",
    "mailto:a@b.c",
    "https://h.org?q=1",
    "https://h.org#x",
    "https://a b.org/with blank",
    "https://h.org/[odd]{chars}|x",
    "",
]


def test_netloc_is_that_of_the_standard_parser(spark):
    assert column(spark, URLS, U.url_netloc) == [urlparse(u).netloc for u in URLS]
    assert column(spark, [None], U.url_netloc) == [""]


def test_host(spark):
    assert column(spark, ["http://me@H.org:80/x", "https://h.org"], U.url_host) == ["h.org", "h.org"]


def test_page_key(spark):
    urls = ["https://h/docs/a", "https://h/docs/a/", "https://h/", "https://h", "none"]
    assert column(spark, urls, U.page_key) == ["docs", "a", "h", "", None]


BASES = [
    "https://h.org/a/b/c",
    "https://h.org/a/b/",
    "https://h.org",
    "https://h.org/",
    "https://h.org/a?x=1#f",
    "http://h.org:81/a/b.html",
]
HREFS = [
    "",
    "x",
    "x/y?z=1#w",
    "./x",
    "../x",
    "../../../x",
    "x/../y",
    "x/./y",
    "x/..",
    "x/.",
    "..",
    ".",
    "/x",
    "/x/../y",
    "/x//y",
    "/../x",
    "//other.org/x",
    "https://other.org/x/../y",
    "mailto:a@b.c",
    "#top",
    "?q=1",
]


@pytest.mark.parametrize("base", BASES)
def test_resolve_href_is_that_of_the_standard_library(spark, base):
    got = column(spark, HREFS, lambda v: U.resolve_href(v, F.lit(base)))
    want = [urljoin(base, h) for h in HREFS]
    # absolute links are kept as they are written
    want[HREFS.index("https://other.org/x/../y")] = "https://other.org/x/../y"
    want[0] = base.split("#")[0]
    assert dict(zip(HREFS, got)) == dict(zip(HREFS, want))


def test_host_domains(spark):
    assert column(spark, ["a.b.c", "localhost"], U.host_domains) == [["a.b.c", "b.c", "c"], ["localhost"]]


def test_allowed_domain(spark):
    hosts = ["h.org", "docs.h.org", "nh.org", "org"]
    assert column(spark, hosts, lambda v: U.allowed_domain(v, F.lit("h.org"))) == [True, True, False, False]


@pytest.mark.parametrize(
    "root,folder,want",
    [
        ("/o", "/o/own/rep/rep-main/src", "rep/rep-main/src"),
        ("/o/own/rep", "/o/own/rep/rep-main/src", "src"),
        ("/o/own/rep", "/o/own/rep/rep-main", ""),
        ("/o", "/o", ""),
        ("/o", "/o/own", ""),
    ],
)
def test_relative_dir(spark, root, folder, want):
    assert column(spark, [folder], lambda v: U.relative_dir(v, F.lit(root))) == [want]


def test_raw_file_url(spark):
    def make(parity):
        return lambda v: U.raw_file_url(F.lit("o/r"), F.lit("main"), v, F.lit("f.md"), parity)

    base = "https://raw.githubusercontent.com/o/r/main/"
    assert column(spark, ["src", ""], make(False)) == [base + "src/f.md", base + "f.md"]
    assert column(spark, ["src", ""], make(True)) == [base + "src/f.md", base + "/f.md"]


def test_commands(spark):
    texts = ["@getcode a/b", "@getcodedoc https://h/", "@getcode   x  ", "@getcoder x", "say @getcode x", "@getcode", None]
    assert column(spark, texts, R.route_command) == ["getcode", "getcodedoc", "getcode", None, None, None, None]
    assert column(spark, texts[:3], R.command_argument) == ["a/b", "https://h/", "x"]


def test_strip_highlight_decodes_the_slash_only(spark):
    assert column(spark, ["<em>a</em>&#x2F;b&amp;c"], R.strip_highlight) == ["a/b&amp;c"]


def test_flags(spark):
    values = ["True", "true", "t", "1", "TRUE", "yes", "0", "", None]
    assert column(spark, values, R.to_flag) == [True] * 4 + [False] * 5
    assert column(spark, [True, False, None], lambda v: R.setting_flag(v, True), "v boolean") == [True, False, True]


def test_modes_with_blank_key(spark):
    keys = [None, "", " \t", "k"]
    assert column(spark, keys, R.search_mode) == ["raw", "raw", "raw", "api"]
    assert column(spark, keys, lambda v: R.fetch_mode(v, F.lit(True))) == ["zip", "zip", "zip", "api"]
    assert column(spark, keys, lambda v: R.fetch_mode(v, F.lit(True), parity=True)) == ["zip", "api", "api", "api"]
    assert column(spark, keys, lambda v: R.fetch_mode(v, F.lit(None).cast("boolean"))) == ["zip"] * 4


def test_pick_profile(spark):
    def pick(*flags, strict=True):
        return lambda v: R.pick_profile(v, *[F.lit(f) for f in flags], strict=strict)

    runs = [str(i) for i in range(60)]
    assert set(column(spark, runs, pick(True, True, True))) == {"chromium", "firefox", "webkit"}
    assert set(column(spark, runs, pick(False, True, False))) == {"firefox"}
    assert column(spark, runs, pick(True, True, False)) == column(spark, runs, pick(True, True, False))
    assert column(spark, ["1"], pick(False, False, False, strict=False)) == [None]
    with pytest.raises(Exception, match="at least one browser"):
        column(spark, ["1"], pick(False, False, False))


def test_resolution_text(spark):
    make = lambda v: R.resolution_text(v, F.lit("q"), F.lit("o/r"), F.lit("u"))
    got = column(spark, [None, 0, 1, 2], make, "v bigint")
    assert got[0] == got[1] == "Sorry I was unable to find any repository with the key: q"
    assert got[2] == "Start downloading repository: o/r u"
    assert got[3] == "I found the following libraries on github:"
