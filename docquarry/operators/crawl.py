"""Breadth-first crawl of stored pages, all projects in one loop.

The queue of a one-page-at-a-time crawler is rebuilt with set operations: a URL enters
the queue at the place of its first discovery, ``(rank of the parent, position on the
parent)``, so one level of the walk is one join, one aggregation and one numbering. Pages
with their links, and the queue, lie hashed in tables, so that a level shuffles only what it finds.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from docquarry.functions import urls
from docquarry.operators.numbering import BUCKET_SPAN, running_totals
from docquarry.session import KeyedTable, all_salts, salt_of, stage

PREVIEW_CHARS = 300

# A page string holds fewer than 2**28 links, so parent and position fit one sortable number;
# its minimum is taken in a hash aggregate, which a minimum of structs is not.
_POS_BITS = 28


@dataclass
class Crawl:
    """``queue``: one row per queued URL ``(project, url, depth, queue_rank, page_rank, page_key, status)``.

    ``status`` is ``stored``, ``failed`` (fetched in vain), ``irrelevant`` (visited, not
    fetched) or ``not_visited`` (past the page limit).
    """

    projects: DataFrame
    queue: DataFrame
    links: DataFrame
    max_depth: int | None

    def pages(self) -> DataFrame:
        """Stored pages in crawl order."""
        return self.chosen().drop("page_key")

    def chosen(self) -> DataFrame:
        """Stored pages with the ``page_key`` that their links had."""
        return self.queue.where(F.col("status") == "stored").select(
            "project", "url", "depth", "page_rank", "page_key"
        )

    def summary(self) -> DataFrame:
        """Five counters per project."""
        return _summary(self)


def prepare_links(links: DataFrame) -> DataFrame:
    """Put everything about a target that does not depend on the project next to the link."""
    return links.select(
        *[c for c in links.columns if c != "dst_url"], "dst_url",
        urls.netloc(F.col("dst_url")).alias("dst_netloc"),
        urls.page_like(F.col("dst_url")).alias("page_like"),
    )


def page_table(links: DataFrame) -> DataFrame:
    """``(url, page_key, links)``: one row per page, in a table hashed by ``url``.

    ``links(src_url, page_key, pos, dst_url)`` has a row with NULL ``pos`` for a page without links. Of several
    versions of a URL, told apart by ``page_key``, the one with the least key is taken, links and all.
    """
    spark = links.sparkSession
    table = KeyedTable(spark, "pages", "url")
    dealt = table.place(prepare_links(links).withColumnRenamed("src_url", "url"))
    versions = dealt.groupBy("url", "page_key").agg(
        F.array_sort(F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "dst_url", "dst_netloc", "page_like")))).alias("links"))
    first = Window.partitionBy("url").orderBy("page_key")
    chosen = versions.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return table.append(chosen, placed=True)


def prepare_projects(projects: DataFrame) -> DataFrame:
    base = F.col("base_url")
    return projects.select(
        "project", "base_url",
        urls.netloc(base).alias("base_netloc"),
        urls.allowed_netloc(base).alias("allowed"),
    )


def _relevant():
    host = F.lower(F.col("dst_netloc"))
    www = F.concat(F.lit("www."), F.col("allowed"))
    return F.col("page_like") & ((host == F.col("allowed")) | (host == www))


def _same_domain():
    return (F.col("dst_netloc") == "") | (F.col("dst_netloc") == F.col("base_netloc"))


def crawl(projects: DataFrame, links: DataFrame, fetched: DataFrame, max_pages: int | None = None,
          max_depth: int | None = None, span: int = BUCKET_SPAN) -> Crawl:
    """Walk the links of every project at once, to the end unless a limit is given.

    ``projects(project, base_url)``; ``links(src_url, pos, dst_url)`` with normalised
    targets; ``fetched(url)``: URLs that could be fetched.
    """
    bare = fetched.select(
        F.col("url").alias("src_url"), F.lit(None).cast(links.schema["pos"].dataType).alias("pos"),
        F.lit(None).cast("string").alias("dst_url"))
    known = links.select("src_url", "pos", "dst_url").join(
        fetched.select(F.col("url").alias("src_url")), "src_url", "left_semi").unionByName(bare)
    return walk(projects, page_table(known.withColumn("page_key", F.lit(0).cast("bigint"))), max_pages, max_depth, span)


def walk(projects: DataFrame, pages: DataFrame, max_pages: int | None = None, max_depth: int | None = None,
         span: int = BUCKET_SPAN) -> Crawl:
    """``crawl`` over a ``page_table``: a level shuffles what it finds, never the pages or what was queued before."""
    spark = projects.sparkSession
    projects = stage(prepare_projects(projects), "projects")
    start = projects.select(
        "project", "base_netloc", "allowed",
        F.col("base_url").alias("url"),
        F.lit(True).alias("wanted"),
        F.lit(0).alias("depth"),
        F.lit(0).cast("bigint").alias("queue_rank"),
    ).join(pages.select("url", "page_key"), "url", "left").withColumn("page_rank", F.lit(0).cast("bigint"))
    queue = KeyedTable(spark, "queue", "project", "url")
    level = _judge(start, max_pages)
    for depth in count():
        seen = Observation()
        found = queue.append(level.observe(seen, F.count_if(F.col("status") == "stored").alias("stored")))
        if depth == max_depth or not seen.get["stored"]:
            break
        level = _judge(_next_level(found.where(F.col("depth") == depth), found, pages, depth, span), max_pages)
    return Crawl(projects, found, pages, max_depth)


def _judge(level: DataFrame, max_pages: int | None) -> DataFrame:
    """What happens to each URL of a level; ``page_rank`` counts the pages stored before it."""
    beyond = F.lit(False) if max_pages is None else F.col("page_rank") >= max_pages
    status = (
        F.when(beyond, "not_visited")
        .when(~F.col("wanted"), "irrelevant")
        .when(F.col("page_key").isNull(), "failed")
        .otherwise("stored")
    )
    return level.withColumn("status", status).select(
        "project", "base_netloc", "allowed", "url", "wanted", "depth", "queue_rank", "status",
        F.when(F.col("status") == "stored", F.col("page_rank")).alias("page_rank"),
        F.when(F.col("status") == "stored", F.col("page_key")).alias("page_key"),
    )


def place(parent: str, pos: str) -> Column:
    """Place of a discovery as one number: the parent's order first, then the position."""
    return F.col(parent) * F.lit(1 << _POS_BITS) + F.col(pos)


def place_parent(column: str) -> Column:
    return F.shiftright(F.col(column), _POS_BITS)


def place_pos(column: str) -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << _POS_BITS) - 1)).cast("int")


def _discovered(level: DataFrame, pages: DataFrame, depth: int) -> DataFrame:
    """Targets on the stored pages of a level, each with the place of its first discovery."""
    taken = level.where(F.col("status") == "stored").select(
        "project", "base_netloc", "allowed", "depth", "url", "queue_rank"
    )
    targets = (
        taken.join(pages.select("url", "links"), "url")
        .select("project", "base_netloc", "allowed", "depth", "queue_rank", F.explode("links").alias("link"))
        .select("project", "base_netloc", "allowed", "depth", "queue_rank", "link.*")
        .where(_same_domain())
        .withColumn("wanted", _relevant())
    )
    if depth > 0:
        targets = targets.where("wanted")
    return targets.groupBy(
        "project", "base_netloc", "allowed", "depth", F.col("dst_url").alias("url"), "wanted"
    ).agg(F.min(place("queue_rank", "pos")).alias("_first"))


def _next_level(level: DataFrame, queued: DataFrame, pages: DataFrame, depth: int, span: int) -> DataFrame:
    """New URLs found on the stored pages of the last level, with their places in the queue."""
    # Every project that goes on has rows in the last level, and its places run on from there.
    totals = level.groupBy("project").agg(
        (F.max("queue_rank") + 1).alias("_queued"), (F.max("page_rank") + 1).alias("_stored"))
    new = stage(
        _discovered(level, pages, depth)
        .join(queued.select("project", "url"), ["project", "url"], "left_anti")
        .join(pages.select("url", "page_key"), "url", "left")
        .select(
            "project", "base_netloc", "allowed", "url", "wanted", "page_key",
            (F.col("depth") + 1).alias("depth"),
            place_parent("_first").alias("_parent"), place_pos("_first").alias("_pos"),
        ),
        f"new_{depth + 1}",
    )
    storable = F.col("wanted") & F.col("page_key").isNotNull()
    numbered = running_totals(
        new, ["project"], ["_parent", "_pos"],
        {"_place": F.lit(1), "_pages": storable.cast("int")}, span,
    )
    return numbered.join(totals, "project").select(
        "project", "base_netloc", "allowed", "url", "wanted", "depth", "page_key",
        (F.col("_queued") + F.col("_place")).alias("queue_rank"),
        (F.col("_stored") + F.col("_pages")).alias("page_rank"),
    )


def _summary(walk: Crawl) -> DataFrame:
    queue, pages = walk.queue, walk.links
    visited = F.col("status") != "not_visited"
    per_queue = queue.groupBy("project").agg(
        F.count_if(F.col("status") == "stored").alias("pages_scraped"),
        F.count_if(visited).alias("urls_visited"),
        (F.count(F.lit(1)) - 1).alias("_queued"),
    )

    # With a depth limit, links of the deepest pages are queued and never taken from the queue.
    deepest = -1 if walk.max_depth is None else walk.max_depth
    last = queue.where(F.col("depth") == deepest)
    beyond = (
        _discovered(last, pages, deepest)
        .join(queue.select("project", "url"), ["project", "url"], "left_anti")
        .groupBy("project")
        .agg(F.count(F.lit(1)).alias("_beyond"))
    )

    # Counted within the row of a page; only refused targets of the page's own domain become rows.
    def own(link):
        return (link["dst_netloc"] == "") | (link["dst_netloc"] == F.col("base_netloc"))

    def relevant(link):
        host = F.lower(link["dst_netloc"])
        return link["page_like"] & ((host == F.col("allowed")) | (host == F.concat(F.lit("www."), F.col("allowed"))))

    refused = F.when(F.col("depth") > 0, F.filter("links", lambda x: own(x) & ~relevant(x))["dst_url"]).otherwise(
        F.array().cast("array<string>"))
    seen = stage(
        queue.where(F.col("status") == "stored").join(pages.select("url", "links"), "url").select(
            "project", "url", F.col("queue_rank").alias("src_rank"), F.size("links").alias("_links"),
            F.size(F.filter("links", lambda x: ~own(x))).alias("_foreign"), refused.alias("_refused")),
        "seen")
    # Only base pages queue unwanted URLs, so this side holds one page of links per project. A link that
    # stands on every page of a site is one key; salting spreads it, the small side is repeated.
    unwanted = queue.where(
        visited & (~F.col("wanted") | (F.col("depth") == 0))
    ).select("project", F.col("url").alias("dst_url"), F.col("queue_rank").alias("dst_rank"), all_salts())
    already = (
        seen.select("project", "src_rank", salt_of("url").alias("_salt"), F.explode("_refused").alias("dst_url"))
        .join(unwanted, ["project", "dst_url", "_salt"])
        .where(F.col("dst_rank") <= F.col("src_rank"))
        .groupBy("project")
        .agg(F.count(F.lit(1)).alias("_already"))
    )
    per_page = seen.groupBy("project").agg(
        F.sum("_links").alias("_found"), F.sum(F.col("_foreign") + F.size("_refused")).alias("_refusable"))

    joined = (
        walk.projects.select("project")
        .join(per_queue, "project", "left")
        .join(per_page, "project", "left")
        .join(beyond, "project", "left")
        .join(already, "project", "left")
        .na.fill(0)
    )
    return joined.select(
        "project", "pages_scraped",
        F.col("_found").alias("links_found"),
        (F.col("_queued") + F.col("_beyond")).alias("links_added"),
        (F.col("_refusable") - F.col("_already")).alias("links_filtered"),
        "urls_visited",
    )


def fetch_status(targets: DataFrame, fetched: DataFrame) -> DataFrame:
    """Each distinct URL with ``fetched`` or ``failed``."""
    hits = fetched.select("url", F.lit(True).alias("_hit"))
    return (
        targets.select("url").distinct().join(hits, "url", "left")
        .select("url", F.when(F.col("_hit"), "fetched").otherwise("failed").alias("status"))
    )


def first_discovery(edges: DataFrame, group: list[str], parent: str) -> DataFrame:
    """One row per URL of a group: the ``parent`` number and ``pos`` where it was seen first."""
    return (
        edges.groupBy(*group, "dst_url")
        .agg(F.min(place(parent, "pos")).alias("_first"))
        .select(
            *group, "dst_url",
            place_parent("_first").alias(parent), place_pos("_first").alias("pos"),
        )
    )


def scrape_report(pages: DataFrame) -> DataFrame:
    """Text length and a one-line preview; ``pages(project, url, page_rank, text)``."""
    preview = F.trim(F.translate(F.substring("text", 1, PREVIEW_CHARS), "\n", " "))
    return pages.select(
        "project", (F.col("page_rank") + 1).alias("page_number"), "url",
        F.length("text").alias("text_chars"), preview.alias("preview"),
    )
