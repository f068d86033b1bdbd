"""The HTML scanner against the standard library's parser and hand-made cases."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from gleanwork.functions.html import decoded, page_links, start_tags
from gleanwork.operators.links import extract_links, scanned_links


class Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.base, self.links = None, {}

    def handle_starttag(self, tag, attrs):
        href = next((v for k, v in attrs if k == "href"), None)
        if tag in ("a", "area") and "href" in dict(attrs):
            self.links.setdefault((href or "").strip(" \t\n\f\r"))
        if tag == "base" and "href" in dict(attrs) and self.base is None:
            self.base = (href or "").strip(" \t\n\f\r")

    handle_startendtag = handle_starttag


def parsed(page):
    parser = Links()
    parser.feed(page)
    return parser.base, list(parser.links)


def test_all_pages(spark, sf_dir):
    for row in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        assert page_links(row.html) == parsed(row.html)


# each states what the public tokenization rules give
CASES = {
    '<a href="/a">x</a><A HREF=/b>y</A><area href=\'/c\'>': ["/a", "/b", "/c"],
    '<a title="1 > 0" href="/a>b">x': ["/a>b"],
    "<a title='\"' href='/q'>x": ["/q"],
    '<a href="/open>text</a><a href="/second">': ["/open>text</a><a href="],
    '<a href="/never closed>text': [],
    '<a href="/x"': [],
    '<a href=/a/>x</a><a href=/b/ >y': ["/a/", "/b/"],
    '<a href = "/sp" >x</a><a\nhref\n=\n"/nl">': ["/sp", "/nl"],
    "<a href>x</a><a href=>y</a>": [""],
    '<a href="/1" href="/2">x': ["/1"],
    '<a data-href="/no" xhref="/no2">x': [],
    '<abbr href="/no">x<address href="/no">': [],
    '<a/href="/slash">x<a / href="/two">': ["/slash", "/two"],
    '<a ="/odd" href="/ok">x': ["/ok"],
    '<a a="1"href="/close">x': ["/close"],
    '<a href="/p?a=1&amp;b=2&copy=3&lt;&#65;&#x42;&notit;&amp">x': ["/p?a=1&b=2&copy=3<AB&notit;&"],
    '<a href="  /blank\t">x': ["/blank"],
    '<!-- <a href="/c"> --><a href="/d">': ["/d"],
    '<!--><a href="/e">': ["/e"],
    '<!---><a href="/f">': ["/f"],
    '<!-- a --!><a href="/g">': ["/g"],
    '<!-- a -- > <a href="/h"> --><a href="/i">': ["/i"],
    '<!-- open <a href="/j">': [],
    '<!doctype html><?xml <a?><a href="/k">': ["/k"],
    '<![CDATA[<a href="/l">]]><a href="/m">': ["/m"],
    '</ <a href="/n"><a href="/o">': ["/o"],
    '</><a href="/p">': ["/p"],
    '<3 <a href="/q">1 < 2 <a href="/r">': ["/q", "/r"],
    '<script>var a = "<a href=\'/s\'>"</script><a href="/t">': ["/t"],
    '<script>x</scripty><a href="/s"></script ><a href="/t">': ["/t"],
    '<SCRIPT>x</script\n><a href="/u">': ["/u"],
    '<script><!-- <script> </script> <a href="/no"> --></script><a href="/v">': ["/v"],
    '<script><!-- </script><a href="/w">': ["/w"],
    '<script><!--> <script></script><a href="/x">': ["/x"],
    '<script><a href="/y">': [],
    '<style>a{}<a href="/z"></style><a href="/1">': ["/1"],
    '<textarea><a href="/2"></textarea><title><a href="/3"></title><a href="/4">': ["/4"],
    '<iframe><a href="/5"></iframe><noembed><a href="/6"></noembed><xmp><a href="/7"></xmp><a href="/8">': ["/8"],
    '<noscript><a href="/9"></noscript><template><a href="/10"></template>': ["/9", "/10"],
    '<a href="/11"></a href="/12"><a href="/11">': ["/11"],
    '<plaintext><a href="/13">': [],
    "<a href='/é/ü'>": ["/é/ü"],
    "<a": [],
    "<": [],
    "": [],
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert page_links(page)[1] == CASES[page]


def test_base_and_null():
    assert page_links('<base target="x"><base href="/b/&amp;"><base href="/c"><a href="d">') == ("/b/&", ["d"])
    assert page_links(None) == (None, [])


def test_references():
    assert decoded("a&b&&c;&#0;&#x110000;&hearts;&hearts") == "a&b&&c;��♥&hearts"
    assert decoded("&copy&copyx&copy=1&copy;") == "©&copyx&copy=1©"


def test_any_text_ends(spark):
    """Random pieces of markup: the scanner ends, and finds what the library finds where that applies."""
    rng = random.Random(3)
    pieces = ["<a ", "href=", '"', "'", ">", "/x", "</a>", "<!--", "-->", "<script>", "</script>", " ", "text", "&amp;", "<b>", "=", "<title>", "</title>", "<a href='/y'>"]
    same = 0
    for _ in range(4000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        tags = list(start_tags(page))
        assert all(re.fullmatch("[a-z][^ >/]*", name) for name, _ in tags)
        same += page_links(page) == parsed(page)
    assert same > 3600


def test_scanned_links_on_tables(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = extract_links(pages)
    assert sorted(map(tuple, scanned_links(pages).collect())) == sorted(map(tuple, want.collect()))
    rows = [(1, "https://h.org/d/p?q#f", '<base href="../b/"><a title=">" href="x&amp;y#z"><a href="mailto:a@b"><a href="x&amp;y#z">'), (2, "https://h.org", None), (3, None, '<a href="/a">')]
    odd = spark.createDataFrame([(*r, "c") for r in rows], "page_id int, url string, html string, base string")
    got = [tuple(r) for r in scanned_links(odd).collect()]
    assert got == [(1, rows[0][1], "https://h.org/b/x&y#z")]
    bare = [tuple(r) for r in scanned_links(odd, keep_fragment=False).collect()]
    assert bare == [(1, rows[0][1], "https://h.org/b/x&y")]
    assert scanned_links(odd.filter(F.lit(False))).count() == 0
