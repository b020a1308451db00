"""Links of stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import let, urls
from docquarry.functions.html import base_href, hrefs
from docquarry.session import all_salts, salt_of

AUDIT_LINKS = 50
AUDIT_EXAMPLES = 10


def base_of(page: Column, html: Column) -> Column:
    """The address that links of a page are relative to: that of its ``base`` element, if any, else its own."""
    return let(base_href(html), lambda base: F.when(base.isNull(), page).otherwise(urls.resolve(base, page)))


def extract_links(pages: DataFrame) -> DataFrame:
    """``pages(url, html)`` to ``(src_url, base_url, pos, href)``, in document order; links are relative to ``base_url``."""
    return pages.select(
        F.col("url").alias("src_url"), base_of(F.col("url"), F.col("html")).alias("base_url"),
        F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))


def resolve_links(links: DataFrame) -> DataFrame:
    """Replace ``base_url`` by ``link_url``, the absolute form of each href."""
    return links.withColumn("link_url", urls.resolve(F.col("href"), F.col("base_url"))).drop("base_url")


def page_links(pages: DataFrame) -> DataFrame:
    """``(src_url, pos, dst_url)`` with normalised targets; malformed links are left out."""
    resolved = resolve_links(extract_links(pages)).where(~urls.is_malformed(F.col("link_url")))
    return resolved.select("src_url", "pos", urls.normalize(F.col("link_url")).alias("dst_url"))


def version_links(pages: DataFrame) -> DataFrame:
    """``(src_url, page_key, pos, dst_url)`` of ``pages(url, html, page_key)``; a page has a row with NULL ``pos``, links or not."""
    found = pages.select(
        F.col("url").alias("src_url"), "page_key", base_of(F.col("url"), F.col("html")).alias("base_url"),
        F.posexplode(F.concat(F.array(F.lit(None).cast("string")), hrefs(F.col("html")))).alias("pos", "href"),
    )
    resolved = resolve_links(found).where(F.col("href").isNull() | ~urls.is_malformed(F.col("link_url")))
    return resolved.select(
        "src_url", "page_key", F.when(F.col("href").isNotNull(), F.col("pos") - 1).alias("pos"),
        urls.normalize(F.col("link_url")).alias("dst_url"))


def link_graph(projects: DataFrame, links: DataFrame) -> DataFrame:
    """Same-domain edges of every project: ``projects(project, base_url)`` and page links.

    The edges of a large host are spread over salts.
    """
    bases = projects.select("project", urls.netloc(F.col("base_url")).alias("base_netloc"), all_salts())
    edges = links.withColumn("base_netloc", urls.netloc(F.col("src_url"))).withColumn(
        "_salt", salt_of("src_url")
    )
    return (
        edges.where(urls.same_domain(F.col("dst_url"), F.col("base_netloc")))
        .join(bases, ["base_netloc", "_salt"])
        .select("project", "src_url", "pos", "dst_url")
    )


def link_audit(pages: DataFrame) -> DataFrame:
    """Per page: link counts, and how its first same-domain links fare with the page filter.

    All of it stays within the row, so nothing is shuffled.
    """
    found = pages.select(
        "url",
        let(
            base_of(F.col("url"), F.col("html")),
            lambda base: F.transform(hrefs(F.col("html")), lambda href: urls.resolve(href, base)),
        ).alias("links"),
    ).withColumn("host", urls.netloc(F.col("url")))
    split = found.select(
        "url",
        "links",
        F.filter(
            "links", lambda link: (urls.netloc(link) == "") | (urls.netloc(link) == F.col("host"))
        ).alias("same"),
    )
    checked = split.withColumn(
        "checked",
        F.transform(
            F.slice("same", 1, AUDIT_LINKS),
            lambda link: let(
                urls.normalize(link),
                lambda normal: F.struct(
                    normal.alias("url"),
                    urls.relevant_docs_url(normal, F.col("url")).alias("passed"),
                ),
            ),
        ),
    )
    passed = F.filter("checked", lambda link: link["passed"])["url"]
    failed = F.filter("checked", lambda link: ~link["passed"])["url"]
    return checked.select(
        "url",
        F.size("links").alias("links_total"),
        F.size("same").alias("same_domain"),
        (F.size("links") - F.size("same")).alias("different_domain"),
        F.size(passed).alias("passed"),
        F.size(failed).alias("filtered_out"),
        F.slice(passed, 1, AUDIT_EXAMPLES).alias("passed_examples"),
        F.slice(failed, 1, AUDIT_EXAMPLES).alias("filtered_examples"),
    )
