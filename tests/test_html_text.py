import random

import pytest
from pyspark.sql import functions as F

from docquarry.functions import html, text
from docquarry.operators import chunks, crawl, links

# The characters str.split() treats as whitespace.
SPACES = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("page, found", [
    ('<a href="/x">1</a><a class="q" href=\'/y\'>2</a><A HREF=/z>3</A>', ["/x", "/y", "/z"]),
    ('<a data-href="/no">1</a><a name=x>2</a><abbr href="/no">', []),
    ('<a href="">1</a><a href="  ">2</a><a href="/k">3</a>', ["/k"]),
    ('<!-- <a href="/no"> --><script>"<a href=\'/no\'>"</script><a href="/x">', ["/x"]),
    ('<a title="a > b" href="/x?a=1&amp;b=2">', ["/x?a=1&b=2"]),
    ('<a\n href = "/x" target=_blank>', ["/x"]),
    ('<a href="/x">1</a><!-- cut <a href="/no">', ["/x"]),
    ("no links", []),
])
def test_hrefs(spark, page, found):
    assert one(spark, page, html.hrefs) == found


@pytest.mark.parametrize("page, seen", [
    ("<html><head><title>T</title></head><body><p>a<p>b<br>c</body>", "a b c"),
    ("x<b>y</b>z", "xyz"),
    ("<script>var t='</p>';</script>a<style>p{}</style>b", "a b"),
    ("a<!-- x --><div>b</div>", "a b"),
    ("a &lt;b&gt; &amp;lt; &nbsp; c", "a <b> &lt; c"),
    ("a<script>never closed", "a"),
    ("", ""),
])
def test_visible_text(spark, page, seen):
    assert one(spark, page, html.visible_text) == seen


def test_every_whitespace_character(spark):
    assert len(SPACES) == 29
    values = [f"a{chr(c)}{chr(c)}b{chr(c)}" for c in SPACES]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(text.clean_text("v")).collect()
    assert {row[0] for row in rows} == {"a b"}
    for other in (0x200B, 0x180E):
        assert one(spark, f"a{chr(other)}b", text.clean_text) == f"a{chr(other)}b"


@pytest.mark.parametrize("count, sizes", [
    (0, []), (1, [1]), (499, [499]), (500, [500]), (501, [500, 1]), (1000, [500, 500]),
])
def test_chunk_sizes(spark, count, sizes):
    value = "\n ".join(f"w{i}" for i in range(count))
    made = one(spark, value, text.chunk_text)
    assert [len(c.split()) for c in made] == sizes
    assert " ".join(made) == " ".join(value.split())


def test_null_and_blank_text(spark):
    pages = spark.createDataFrame(
        [("p", "u1", 0, None), ("p", "u2", 1, "  \n"), ("p", "u3", 2, "x"), ("q", "u4", 0, "")],
        "project string, url string, page_rank long, text string")
    prepared = chunks.prepare_pages(pages)
    assert [(r.url, r.id) for r in chunks.number_chunks(prepared).collect()] == [("u3", "0")]
    projects = spark.createDataFrame([("p",), ("q",), ("r",)], "project string")
    status = {r.project: (r.chunk_count, r.status)
              for r in chunks.corpus_status(projects, prepared).collect()}
    assert status == {"p": (1, "indexed"), "q": (0, "no_content"), "r": (0, "no_content")}


def test_ids_follow_page_order_across_buckets(spark):
    rng = random.Random(3)
    rows = [(f"p{p}", f"u{p}-{i}", i, " ".join(["w"] * rng.choice([0, 3, 7, 12])))
            for p, n in (("big", 60), ("small", 3)) for i in range(n)]
    pages = spark.createDataFrame(rows, "project string, url string, page_rank long, text string")
    made = chunks.number_chunks(chunks.prepare_pages(pages), max_words=5, span=4).collect()
    for project in ("pbig", "psmall"):
        mine = sorted((r.page_rank, r.chunk_pos, int(r.id)) for r in made if r.project == project)
        assert [n for _, _, n in mine] == list(range(len(mine)))


def test_report_and_audit(spark):
    pages = spark.createDataFrame(
        [("p", "https://d.com/x", 0, "a" * 400), ("p", "https://d.com/y", 1, " b\nc ")],
        "project string, url string, page_rank long, text string")
    report = {r.page_number: (r.text_chars, r.preview) for r in crawl.scrape_report(pages).collect()}
    assert report == {1: (400, "a" * 300), 2: (5, "b c")}
    body = "".join(f'<a href="/n{i}">' for i in range(60))
    body += '<a href="/blog/1"><a href="https://o.org/"><a href="mailto:x@y">'
    page = spark.createDataFrame([("https://d.com/x", body)], "url string, html string")
    row = links.link_audit(page).first()
    # mailto has no host of its own, so it counts as same-domain here
    assert (row.links_total, row.same_domain, row.different_domain) == (63, 62, 1)
    assert (row.passed, row.filtered_out) == (50, 0)
    assert row.passed_examples == [f"https://d.com/n{i}" for i in range(10)]


def test_character_references(spark):
    """Numeric and named references are decoded once, as the standard library does it."""
    import html

    from docquarry.functions.html import decode_entities, hrefs

    texts = ["it&#39;s &mdash; &#x41;", "&amp;#39; &amp;amp; x", "&unknown; &;", "a & b &lt;p&gt;", "",
             "&#X1F600;&eacute;&Eacute;", None, "&hellip;&hellip;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(decode_entities(F.col("t")).alias("t"))
    assert [r.t for r in df.collect()] == [t and html.unescape(t) for t in texts]
    link = spark.createDataFrame([('<a href="/x&#38;y">z</a>',)], "h string").select(hrefs(F.col("h")).alias("l"))
    assert link.first().l == ["/x&y"]
