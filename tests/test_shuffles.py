"""What the index job, the crawl and the numbering move, with broadcasts off as on large tables."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import chunks, crawl
from docquarry.operators.numbering import ordered_totals
from docquarry.plans import jobs
from docquarry.session import KeyedTable, maybe_in, scope, stage_keyed
from docquarry.sources.store import CollectionStore
from tests.plans import no_broadcast, scans_below_shuffles, settings, shuffled_columns


@pytest.fixture()
def appended(monkeypatch):
    """Every DataFrame that is appended to a hashed table, by the columns it is hashed by."""
    seen = []
    append = KeyedTable.append

    def record(self, df, placed=False):
        seen.append((self.keys, df if placed else self.place(df), self.table))
        return append(self, df, placed)

    monkeypatch.setattr(KeyedTable, "append", record)
    return seen


def site(spark, path, n=60, versions=1):
    rows = [(f"https://d.org/p{i}", f'<p>version {v} of {i}</p><a href="/p{2 * i + 1}">a</a><a href="p{2 * i + 2}">b</a>' + "x " * v)
            for i in range(n) for v in range(versions)]
    random.Random(versions).shuffle(rows)
    spark.createDataFrame(rows, "url string, html string").repartition(5).write.parquet(str(path))
    return spark.read.parquet(str(path))


def bases(spark):
    return spark.createDataFrame([("d", "https://d.org/p0")], "project string, base_url string")


def test_html_stays_in_the_scan(spark, tmp_path, appended):
    with no_broadcast(spark):
        jobs.index_documentation(bases(spark), site(spark, tmp_path / "pages"), CollectionStore(spark, str(tmp_path / "s")))
        moved = {keys: [c for df_columns in shuffled_columns(df) for c in df_columns] for keys, df, _ in appended}
    assert set(moved) == {("url",), ("project", "url"), ("url", "page_key")}
    for columns in moved.values():
        assert "html" not in columns
    # Text moves once, to where it stays.
    assert moved["url", "page_key"].count("text") == 1


def test_numbers_meet_the_text_where_it_lies(spark):
    rows = [(f"p{p}", f"u{i}", (i * 7919) ** 2, " ".join(["w"] * (i % 13))) for p, n in (("big", 400), ("small", 3)) for i in range(n)]
    pages = chunks.prepare_pages(spark.createDataFrame(rows, "project string, url string, page_rank long, text string"))
    with no_broadcast(spark):
        lying = stage_keyed(pages, "prepared", "project", "page_rank")
        made = chunks.number_chunks(lying, max_words=5, keys=("project", "page_rank"))
        assert all("text" not in columns for columns in shuffled_columns(made))
        got = sorted((r.project, int(r.id), r.url, r.chunk_pos) for r in made.collect())
        plain = sorted((r.project, int(r.id), r.url, r.chunk_pos) for r in chunks.number_chunks(pages, max_words=5).collect())
    want = []
    for project in ("big", "small"):
        own = sorted((r for r in rows if r[0] == f"p{project}"), key=lambda r: r[2])
        parts = [(r[1], k) for r in own for k in range(-(-len(r[3].split()) // 5))]
        want += [(f"p{project}", at, url, k) for at, (url, k) in enumerate(parts)]
    assert got == plain == sorted(want)


def test_projects_that_share_a_page_number_their_own(spark):
    rows = [(p, u, 0, rank, "a b c") for p, urls in (("x", "abc"), ("y", "cab")) for rank, u in enumerate(urls)]
    pages = chunks.prepare_pages(spark.createDataFrame(rows, "project string, url string, page_key int, page_rank long, text string"))
    lying = stage_keyed(pages, "prepared", "url", "page_key")
    made = chunks.number_chunks(lying, max_words=2, keys=("url", "page_key"))
    assert sorted((r.project, r.id, r.url) for r in made.collect()) == [
        ("x", "0", "a"), ("x", "1", "a"), ("x", "2", "b"), ("x", "3", "b"), ("x", "4", "c"), ("x", "5", "c"),
        ("y", "0", "c"), ("y", "1", "c"), ("y", "2", "a"), ("y", "3", "a"), ("y", "4", "b"), ("y", "5", "b")]


def test_sparse_ranks_spread_over_tasks(spark):
    df = spark.range(5000).select(F.lit("one").alias("g"), (F.col("id") * F.col("id") * 10_007).alias("o"))
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        out = ordered_totals(df, ["g"], ["o"], {"n": F.lit(1)}, {"n": "all"})
    assert [r.n for r in out.orderBy("o").collect()] == list(range(5000))
    assert out.agg(F.min("all"), F.max("all")).first() == (5000, 5000)
    staged = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in out.inputFiles()})
    ranges = [r["count"] for r in staged.groupBy("_range").count().collect()]
    assert len(ranges) > 4 and max(ranges) < 5 * 5000 / len(ranges)


def test_a_level_shuffles_what_it_finds(spark):
    edges = spark.range(200).select(
        F.concat(F.lit("https://d.org/p"), "id").alias("src_url"), F.lit(0).alias("pos"),
        F.concat(F.lit("https://d.org/p"), F.col("id") * 2 + 1).alias("dst_url"))
    fetched = edges.select(F.col("src_url").alias("url"))
    with no_broadcast(spark):
        walk = crawl.crawl(bases(spark), edges, fetched)
        level = walk.queue.where("depth = 2")
        found = crawl._discovered(level, walk.links, 2)
        fresh = found.join(walk.queue.select("project", "url"), ["project", "url"], "left_anti")
        assert all("links" not in columns for columns in shuffled_columns(fresh))
        tables = {f"docquarry_{t}" for t in __import__("re").findall(r"docquarry_([0-9a-f]{32})", fresh._jdf.queryExecution().executedPlan().toString())}
        pages_table = next(t for t in tables if "links" in spark.table(t).columns)
        assert scans_below_shuffles(fresh, pages_table) == []
        assert "SortMergeJoin" in fresh._jdf.queryExecution().executedPlan().toString()
        queue_side = walk.queue.select("project", "url").join(spark.createDataFrame(
            [("d", "x")], "project string, url string"), ["project", "url"])
        queue_table = next(t for t in tables if t != pages_table)
        assert scans_below_shuffles(queue_side, queue_table) == []
    assert [r.depth for r in walk.pages().orderBy("page_rank").collect()] == list(range(8))


def test_versions_of_a_page_give_the_same_collection(spark, tmp_path):
    stores, once = [], site(spark, tmp_path / "pages", 25, versions=4)
    for run in range(3):
        pages = once.union(once).repartition(run + 2)
        store = CollectionStore(spark, str(tmp_path / str(run)))
        jobs.index_documentation(bases(spark), pages, store)
        stores.append(sorted((r.id, r.document, r.page_url) for r in store.scan().collect()))
    assert stores[0] == stores[1] == stores[2] and len(stores[0]) == 25


def test_filter_lets_all_members_through(spark):
    keys = spark.range(1000).select((F.col("id") * 3).alias("k"), F.lit("s").alias("s"))
    df = spark.range(100_000).select(F.col("id").alias("k"), F.lit("s").alias("s"), F.lit("payload").alias("p")).union(
        spark.createDataFrame([(None, "s", "p")], "k long, s string, p string"))
    passed = maybe_in(df, ["k", "s"], keys)
    assert all("p" not in columns for columns in shuffled_columns(passed))
    got = {r.k for r in passed.collect()}
    assert {i * 3 for i in range(1000)} <= got and len(got) < 15_000 and passed.columns == ["k", "s", "p"]
    assert maybe_in(df, ["k"], keys.limit(0)).count() == 0


def test_hashed_tables_go_with_their_scope(spark):
    with scope(spark):
        table = KeyedTable(spark, "t", "id")
        table.append(spark.range(10))
        assert table.append(spark.range(10, 15)).count() == 15
        assert spark.catalog.tableExists(table.table)
    assert not spark.catalog.tableExists(table.table)
