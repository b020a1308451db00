import json

import pytest
from pyspark.sql import functions as F

from docquarry.functions import urls
from docquarry.operators import registry
from docquarry.operators.embedding import Provider
from docquarry.plans.jobs import index_and_search, index_documentation, search_docs
from docquarry.schemas import COLLECTION, PROJECTS
from docquarry.session import scratch_root
from docquarry.sources.projects import find_projects, read_projects, write_projects
from docquarry.sources.store import CollectionStore


def rows(spark, *items):
    return spark.createDataFrame(
        [(c, i, d, [1.0, 2.0], {"source": c}, "u", 0) for c, i, d in items], COLLECTION)


def content(df):
    return sorted((r.collection_name, r.id, r.document) for r in df.collect())


def test_store(spark, tmp_path):
    store = CollectionStore(spark, f"{tmp_path}/store")
    assert store.scan().count() == 0 and store.first().first()[0] is None
    store.write(rows(spark, ("b", "0", "x"), ("b", "1", "y"), ("a", "0", "z")))
    assert store.first().first()[0] == "a"
    assert store.scan().schema == COLLECTION
    # replaced as a whole; other collections stay
    store.write(rows(spark, ("b", "5", "n")))
    assert content(store.scan()) == [("a", "0", "z"), ("b", "5", "n")]
    # only new ids are inserted
    store.add(rows(spark, ("b", "5", "other"), ("b", "6", "m"), ("c", "0", "k")))
    assert content(store.scan("b", "c")) == [("b", "5", "n"), ("b", "6", "m"), ("c", "0", "k")]
    store.delete(spark.createDataFrame([("b", "5"), ("b", "77"), ("gone", "1")], "collection_name string, id string"))
    assert content(store.scan("b")) == [("b", "6", "m")]
    store.add(rows(spark, ("d", "1", "x"), ("d", "1", "x"), ("d", "1", "y")))
    assert store.scan("d").count() == 1
    store.delete(spark.createDataFrame([("b", "6"), ("d", "1")], "collection_name string, id string"))
    assert store.open("b").count() == 0 and store.exists("b")
    store.clear("c")
    store.clear("c")
    assert {r.collection_name: r.record_count for r in store.counts().collect()} == {"a": 1}
    assert not store.exists("new") and store.open("new").count() == 0 and store.exists("new")


def test_one_folder_is_read(spark, tmp_path):
    store = CollectionStore(spark, f"{tmp_path}/store")
    store.write(rows(spark, ("b", "0", "x"), ("a", "0", "z")))
    plan = store.scan("a").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection_name" in plan
    assert "ReadSchema: struct<id:string>" in plan


def test_registry_files(spark, tmp_path):
    projects = spark.createDataFrame([("p", "https://d.com", "c", "s", None)], PROJECTS)
    write_projects(projects, f"{tmp_path}/lines")
    assert read_projects(spark, f"{tmp_path}/lines").collect() == projects.collect()
    for name in ("one", "two"):
        folder = tmp_path / "folders" / name
        folder.mkdir(parents=True)
        (folder / "project.json").write_text(json.dumps({"name": name, "url": "https://d.com"}, indent=2))
    found = read_projects(spark, f"{tmp_path}/folders", one_file_each=True)
    assert sorted(r.name for r in found.collect()) == ["one", "two"]
    names = spark.createDataFrame([("one",), ("three",)], "name string")
    assert {r.name: r.error for r in find_projects(found, names).collect()} == {
        "one": None, "three": "project_not_found"}


def test_add_and_list_projects(spark):
    existing = spark.createDataFrame([("old", "https://o.com", "c", "s", None)], PROJECTS)
    new = spark.createDataFrame(
        [("old", "https://x.com"), ("new", "https://b.com"), ("new", "https://a.com")], "name string, url string")
    added = registry.add_projects(existing, new, "root")
    assert {(r.name, r.url): r.reason for r in added.collect()} == {
        ("old", "https://x.com"): "project_exists", ("new", "https://b.com"): "project_exists",
        ("new", "https://a.com"): None}
    kept = registry.accepted(added)
    assert kept.schema.names == PROJECTS.names and kept.count() == 1
    everything = existing.unionByName(kept).unionByName(
        spark.createDataFrame([("bare", None, None, None, "own")], PROJECTS))
    stored = kept.select("collection_name", F.lit(7).alias("record_count")).unionByName(
        spark.createDataFrame([("c", None)], "collection_name string, record_count int"))
    listed = [(r.name, r.url, r.status) for r in registry.list_projects(everything, stored).collect()]
    assert listed == [("bare", "N/A", "Not indexed"), ("new", "https://a.com", "Indexed (7 documents)"),
                      ("old", "https://o.com", "Index may be incomplete")]
    providers = lambda g: {r.name: r.provider for r in registry.resolve_provider(everything, g).collect()}
    assert providers(None) == {"bare": "own", "new": "openai", "old": "openai"}
    assert providers("shared")["new"] == "shared" and providers("")["new"] == "openai"


PAGES = [
    ("https://a.org/", '<a href="guide">g</a><a href="/blog">b</a> start'),
    ("https://a.org/guide", '<p>guide text</p><a href="../next?x=1#f">n</a>'),
    ("https://a.org/next?x=1", "<script>no</script>" + "word " * 1200),
    ("https://a.org/blog", "never"),
    ("https://b.org/home", '<a href="/lost">l</a><a href="/two">2</a>only b'),
    ("https://b.org/two", "<b>second</b> page"),
    ("https://b.org/lost", None),
    ("https://c.org/", "<p> </p>"),
    ("https://d.org/", "not asked for"),
]
BASES = [("a", "https://a.org/"), ("b", "https://b.org/home"), ("c", "https://c.org/"), ("x", "https://x.org/")]


def index(spark, path, bases, **options):
    store = CollectionStore(spark, str(path))
    pages = spark.createDataFrame(PAGES, "url string, html string")
    run = index_documentation(spark.createDataFrame(bases, "project string, base_url string"), pages, store, **options)
    return store, run


def test_many_projects_equal_single_runs(spark, tmp_path):
    store, run = index(spark, tmp_path / "all", BASES)
    assert {r.project: (r.chunk_count, r.status) for r in run.status.collect()} == {
        "a": (5, "indexed"), "b": (2, "indexed"), "c": (0, "no_content"), "x": (0, "no_content")}
    together = sorted((r.collection_name, int(r.id), r.page_url, r.document, tuple(r.embedding))
                      for r in store.scan().collect())
    alone = []
    for base in BASES:
        one, _ = index(spark, tmp_path / base[0], [base])
        alone += [(r.collection_name, int(r.id), r.page_url, r.document, tuple(r.embedding))
                  for r in one.scan().collect()]
    assert together == sorted(alone)
    first = [t for t in together if t[2].startswith("https://a.org")]
    assert [t[1] for t in first] == [0, 1, 2, 3, 4]
    assert [t[2] for t in first] == ["https://a.org/", "https://a.org/guide"] + ["https://a.org/next?x=1"] * 3
    assert first[0][3] == "gb start" and first[1][3] == "guide text n"


def test_search_after_index(spark, tmp_path):
    store, _ = index(spark, tmp_path / "s", BASES)
    name = urls.collection_name(F.lit("https://a.org/"))
    queries = spark.createDataFrame([(1, "guide text n"), (2, None)], "query_id long, query_text string").select(
        "query_id", name.alias("collection_name"), "query_text",
        F.lit(None).cast("array<float>").alias("query_embedding"), F.lit(2).alias("top_k"))
    found = search_docs(queries, store.scan()).collect()
    best = [r for r in found if r["rank"] == 1]
    assert [(r.query_id, r.document, r.score) for r in best] == [(1, "guide text n", 0.0)]
    assert [r.error for r in found if r.query_id == 2] == ["invalid_query"]
    assert best[0].metadata == {"source": "https://a.org/"}


def test_provider_per_project(spark, tmp_path):
    bases = spark.createDataFrame([("a", "https://a.org/", "own"), ("b", "https://b.org/home", "hashed")],
                                  "project string, base_url string, embedding_provider string")
    store = CollectionStore(spark, str(tmp_path / "p"))
    providers = {"own": Provider("own", "m", 1, function=lambda ts: [[1.0] for _ in ts]), "hashed": Provider()}
    index_documentation(bases, spark.createDataFrame(PAGES, "url string, html string"), store, providers)
    sizes = store.scan().groupBy(F.col("metadata")["source"].alias("s")).agg(F.collect_set(F.size("embedding")).alias("n"))
    assert {r.s: r.n for r in sizes.collect()} == {"https://a.org/": [1], "https://b.org/home": [64]}


def test_search_with_the_provider_of_the_index(spark, tmp_path):
    bases = spark.createDataFrame([("a", "https://a.org/", "own"), ("b", "https://b.org/home", "hashed")],
                                  "project string, base_url string, embedding_provider string")
    own = Provider("own", "m", 1, function=lambda ts: [[float(len(t))] for t in ts])
    names = {p: spark.range(1).select(urls.collection_name(F.lit(u))).first()[0]
             for p, u in (("a", "https://a.org/"), ("b", "https://b.org/home"))}
    queries = spark.createDataFrame(
        [(1, names["a"], "guide text n", None, 1), (2, names["b"], "second page", None, 1), (3, "none", "x", None, 1),
         (4, names["a"], "x", None, 0), (5, names["a"], None, [1.0, 2.0], 1), (6, names["b"], None, [float("nan")] * 64, 1)],
        "query_id long, collection_name string, query_text string, query_embedding array<float>, top_k int")
    found = index_and_search(bases, spark.createDataFrame(PAGES, "url string, html string"),
                             CollectionStore(spark, str(tmp_path / "w")), queries, {"own": own, "hashed": Provider()})
    got = {r.query_id: (r.document, r.error) for r in found.collect()}
    assert got == {1: ("guide text n", None), 2: ("second page", None), 3: (None, "unknown_collection"),
                   4: (None, "invalid_top_k"), 5: (None, "dimension_mismatch"), 6: (None, "invalid_query")}


def test_repeated_pages_change_nothing(spark, tmp_path):
    stores = []
    for name, pages in (("one", PAGES), ("two", PAGES + PAGES)):
        store = CollectionStore(spark, str(tmp_path / name))
        run = index_documentation(spark.createDataFrame(BASES, "project string, base_url string"),
                                  spark.createDataFrame(pages, "url string, html string"), store)
        stores.append((content(store.scan()), sorted(map(tuple, run.walk.summary().collect()))))
    assert stores[0] == stores[1]


def test_shared_base_url_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="https://a.org/"):
        index(spark, tmp_path / "r", BASES + [("again", "https://a.org/")])


def test_stored_text_wins(spark, tmp_path):
    pages = spark.createDataFrame(
        [("https://a.org/", '<a href="/x">from html</a>', "rendered\n text"), ("https://a.org/x", "plain", None)],
        "url string, html string, text string")
    store = CollectionStore(spark, str(tmp_path / "t"))
    index_documentation(spark.createDataFrame([("a", "https://a.org/")], "project string, base_url string"), pages, store)
    assert sorted((r.id, r.document) for r in store.scan().collect()) == [("0", "rendered text"), ("1", "plain")]


def test_page_limit_in_job(spark, tmp_path):
    _, run = index(spark, tmp_path / "l", BASES[:1], max_pages=1)
    assert [r.url for r in run.walk.pages().collect()] == ["https://a.org/"]
    assert [r.truncated for r in run.status.collect()] == [True]
    _, run = index(spark, tmp_path / "m", BASES[:1])
    assert [r.truncated for r in run.status.collect()] == [False]


def test_scratch_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        pytest.skip("no shared folder configured")
    assert scratch_root(spark) == configured.rstrip("/")
