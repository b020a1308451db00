"""The tag scanner against the parser of the standard library."""

import os
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from docquarry.functions import html
from docquarry.operators import links

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BLOCKS = set(html.BLOCK_TAGS) - {"h[1-6]"} | {f"h{n}" for n in range(1, 7)}
HIDDEN = {"head", *html.UNSEEN_TAGS}


class Model(HTMLParser):
    """Links, base and text by a parser that knows nothing of the patterns."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.base, self.parts, self.hidden = [], None, [], []

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        value = next((v for name, v in attrs if name == "href"), None)
        if tag == "a" and (value or "").strip(" "):
            self.links.append(value)
        if tag == "base" and self.base is None and (value or "").strip(" "):
            self.base = value
        if tag in HIDDEN:
            self.hidden.append(tag)
            self.parts.append(" ")
        elif tag in BLOCKS:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
        elif not self.hidden and tag in BLOCKS:
            self.parts.append(" ")

    def handle_comment(self, data):
        if not self.hidden:
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def model(page):
    parser = Model()
    parser.feed(page)
    parser.close()
    return parser.links, parser.base, " ".join("".join(parser.parts).split())


def scanned(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    page = F.col("html")
    rows = df.select("i", html.hrefs(page).alias("h"), html.base_href(page).alias("b"), html.visible_text(page).alias("t")).collect()
    return {r.i: (r.h, r.b, r.t) for r in rows}


CASES = [
    '<a title="a > b" href="/x">one</a> two',
    "<b title='x > y'>bold</b><img alt=\"<p>not a tag</p>\">after",
    '<div data-x="<a href=\'/no\'>">in</div><a href="/yes">out</a>',
    '<a class="q"href="/x">glued</a>',
    '<a href="/first" href="/second">twice</a>',
    '<a href>none</a><a href="">empty</a><a href=/plain/>slash</a>',
    "<a\n\thref\n=\n'/lines'>x</a>",
    '<a HREF="/up">x</a><A Href=/mixed>y</A>',
    '<a data-href="/no" xhref="/no">x</a><abbr href="/no">y</abbr>',
    "<p>a<pre>b</pre><p-x>c</p-x>d",
    "<!-- <a href='/no'> > -->a<!-- > - >-->b",
    '<script>if (a < b) document.write("<a href=\'/no\'>x</a>")</script>seen',
    "<style>a > b { content: '</p>' }</style>seen",
    "1 < 2 and 3 > 2 &amp; so on",
    "<!DOCTYPE html><html><head><meta charset='x'></head><body>text</body></html>",
    "<a name=x>1</a><a name='href=\"/no\"' href=/y>2</a><a hreflang=en href='/z' title='>'>3</a>",
    "<!-- <base href='/no/'> --><base href=\"/b/\"><a href='x'>y</a><base href='/c/'>",
    "a &lt;b&gt; &eacute; &#65;&#x42; &amp;lt;",
    "",
]


@pytest.mark.parametrize("page", CASES)
def test_equals_the_standard_parser(spark, page):
    assert scanned(spark, [page])[0] == model(page)


def test_all_pages(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    pages = [r.html for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("html").collect()]
    assert scanned(spark, pages) == {i: model(page) for i, page in enumerate(pages)}


def test_what_is_cut_off_or_null(spark):
    got = scanned(spark, [
        'a<!-- cut <a href="/no">', 'a<script>cut <a href="/no">', 'a <b class="x', 'a <a href="/no', 'x <a href="broken>y</a>'])
    assert got[0] == ([], None, "a") and got[1] == ([], None, "a")
    assert got[2] == ([], None, 'a <b class="x') and got[3][0] == []
    assert got[4] == ([], None, "x y")
    # Releases of the standard library differ here; by the HTML standard a space does not end a comment.
    assert scanned(spark, ["a<!-- -- > -->b<!-->c<!--->d<!-- x --!>e"])[0][2] == "a b c d e"
    assert spark.createDataFrame([(None,)], "h string").select(html.visible_text(F.col("h"))).first()[0] is None
    assert spark.createDataFrame([(None,)], "h string").select(html.hrefs(F.col("h"))).first()[0] is None


def test_very_long_tokens(spark):
    """No repetition needs a stack as deep as the token is long."""
    n = 200_000
    many = "<a " + " ".join(f'x{i}="{i} > {i}"' for i in range(n // 10)) + ' href="/end">z</a>'
    got = scanned(spark, ["<!--" + "-x" * n + "-->a", "<b title='" + "<p>" * n + "'>b</b>", many, "<" * n, "x" * n])
    assert got[0][2] == "a" and got[1][2] == "b"
    assert got[2] == (["/end"], None, "z")
    assert got[3][2] == "<" * n and got[4][2] == "x" * n


def test_base_element(spark):
    page = ('<head><base target="_top"><base href="/docs/v2/"><base href="/no/"></head>'
            '<a href="intro">1</a><a href="/root">2</a><a href="https://o.org/x">3</a>')
    df = spark.createDataFrame([("https://d.com/a/b", page), ("https://d.com/a/c", '<a href="intro">')], "url string, html string")
    found = links.resolve_links(links.extract_links(df))
    assert {(r.src_url[-1], r.pos): r.link_url for r in found.collect()} == {
        ("b", 0): "https://d.com/docs/v2/intro", ("b", 1): "https://d.com/root", ("b", 2): "https://o.org/x",
        ("c", 0): "https://d.com/a/intro"}
    targets = {r.dst_url for r in links.version_links(df.withColumn("page_key", F.lit(1))).where("pos = 0").collect()}
    assert targets == {"https://d.com/docs/v2/intro", "https://d.com/a/intro"}
    audit = links.link_audit(df.where("url like '%b'")).first()
    assert audit.passed_examples == ["https://d.com/docs/v2/intro", "https://d.com/root"]
