"""Manifest of the store, what a failure leaves, providers kept with collections, and calls in order."""

import os

import pytest
from pyspark.sql import functions as F

from docquarry.operators.embedding import Provider, embed_by_provider, embed_in_order
from docquarry.plans.jobs import search_docs
from docquarry.schemas import COLLECTION
from docquarry.sources.store import CollectionStore
from tests.plans import no_broadcast


def rows(spark, *items, size=2):
    return spark.createDataFrame(
        [(c, i, d, [1.0] * size, {"source": c}, "u", 0) for c, i, d in items], COLLECTION)


def content(df):
    return sorted((r.collection_name, r.id, r.document) for r in df.collect())


def made(spark, path):
    store = CollectionStore(spark, str(path))
    store.write(rows(spark, ("a", "0", "x"), ("b:/ %c", "0", "y"), ("b:/ %c", "1", "z")))
    return store


def test_one_collection_lists_no_other(spark, tmp_path):
    store = made(spark, tmp_path)
    store.write(rows(spark, ("c", "0", "w")))
    assert content(store.scan("b:/ %c")) == [("b:/ %c", "0", "y"), ("b:/ %c", "1", "z")]
    files = store.scan("b:/ %c").inputFiles()
    assert files and all("collection_name=b" in f for f in files)
    # Other folders may be anything at all: nothing looks at them.
    (write,) = {r.write for r in store.manifest().where("collection_name = 'c'").collect()}
    folder = tmp_path / "data" / f"write={write}" / "collection_name=c"
    for name in os.listdir(folder):
        (folder / name).write_bytes(b"broken")
    assert store.scan("a", "b:/ %c").count() == 3 and store.scan("none").count() == 0
    assert {r.collection_name: r.record_count for r in store.counts().collect()} == {"a": 1, "b:/ %c": 2, "c": 1}
    assert all("/manifest/v" in f for f in store.counts().inputFiles())


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    store = made(spark, tmp_path)
    before = content(store.scan())
    bad = rows(spark, ("a", "5", "new"), ("a", "6", "new")).withColumn(
        "document", F.when(F.col("id") == "6", F.raise_error(F.lit("no"))).otherwise(F.col("document")))
    with pytest.raises(Exception, match="no"):
        store.write(bad)
    assert content(store.scan()) == before and content(store.scan("a")) == [("a", "0", "x")]
    (tmp_path / "data" / "write=left" / "collection_name=a").mkdir(parents=True)  # as a lost driver would
    assert content(store.scan()) == before and store.vacuum() == 1 and content(store.scan()) == before


def test_two_writers_do_not_lose_each_other(spark, tmp_path):
    store = made(spark, tmp_path)
    version, now = store._version(), store.manifest()
    store.write(rows(spark, ("c", "0", "w")))
    with pytest.raises(Exception, match="(?i)exist"):
        store._commit(now, version)
    assert {r.collection_name for r in store.scan().collect()} == {"a", "b:/ %c", "c"}


def test_replaced_records_are_gone_and_removed(spark, tmp_path):
    store = made(spark, tmp_path)
    store.write(rows(spark, ("a", "7", "new")))
    assert content(store.scan()) == [("a", "7", "new"), ("b:/ %c", "0", "y"), ("b:/ %c", "1", "z")]
    assert store.vacuum() == 0  # the first write still holds the other collection
    store.clear("b:/ %c")
    assert store.exists("b:/ %c") and store.scan("b:/ %c").count() == 0
    assert store.vacuum() == 1 and content(store.scan()) == [("a", "7", "new")]
    assert len(os.listdir(tmp_path / "manifest")) <= 3


def test_insertion_reads_its_collections_only(spark, tmp_path):
    store = made(spark, tmp_path)
    with no_broadcast(spark):
        plan = store.scan_for(rows(spark, ("a", "0", "n"))).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection_name" in plan and "Location: InMemoryFileIndex(1 paths)" in plan
    store.add(rows(spark, ("a", "0", "other"), ("a", "1", "n2"), ("a", "1", "n1"), ("d", "0", "k")))
    first = content(store.scan("a", "d"))
    assert first[0] == ("a", "0", "x") and first[2] == ("d", "0", "k") and first[1][2] in ("n1", "n2")
    again = made(spark, tmp_path / "again")
    again.add(rows(spark, ("a", "1", "n1"), ("d", "0", "k"), ("a", "1", "n2"), ("a", "0", "other")).repartition(3))
    assert content(again.scan("a", "d")) == first


def test_provider_is_kept_and_compared(spark, tmp_path):
    store = CollectionStore(spark, str(tmp_path))
    providers = spark.createDataFrame([("a", "hashed", "hashed-words", 128), ("b", "own", "m1", 7)],
                                      "collection_name string, provider_name string, provider_model string, provider_batch_size int")
    mixed = rows(spark, ("m", "0", "x"), size=64).union(rows(spark, ("m", "1", "y")))
    store.write(rows(spark, ("a", "0", "x"), ("b", "0", "y"), ("n", "0", "z"), size=64).union(mixed), providers)
    store.add(rows(spark, ("b", "1", "later"), size=64))
    store.delete(spark.createDataFrame([("a", "0")], "collection_name string, id string"))
    store.add(rows(spark, ("a", "2", "back"), size=64))
    kept = {r.collection_name: (r.record_count, r.longest, r.provider_name, r.provider_model) for r in store.contracts().collect()}
    assert kept == {"a": (1, 64, "hashed", "hashed-words"), "b": (2, 64, "own", "m1"), "n": (1, 64, None, None), "m": (2, 64, None, None)}
    queries = spark.createDataFrame(
        [(1, "a", "text", None, 1), (2, "b", "text", None, 1), (3, "b", None, [1.0] * 64, 1), (4, "n", "text", None, 1),
         (5, "m", "text", None, 1), (6, "a", None, [1.0], 1), (7, "gone", "text", None, 1)],
        "query_id long, collection_name string, query_text string, query_embedding array<float>, top_k int")
    found = search_docs(queries, store.scan_for(queries), contracts=store.contracts())
    assert {r.query_id: r.error for r in found.collect()} == {
        1: None, 2: "provider_mismatch", 3: None, 4: None, 5: "mixed_dimensions", 6: "dimension_mismatch", 7: "unknown_collection"}


def test_all_functions_share_a_pass(spark):
    own = [Provider(f"p{n}", "m", 1, batch_size=4, function=lambda ts, n=n: [[float(n), float(len(ts))] for _ in ts]) for n in range(3)]
    df = spark.range(0, 60, 1, 2).select("id", F.concat(F.lit("p"), (F.col("id") % 4).cast("string")).alias("p"), F.lit("w").alias("document"))
    found = embed_by_provider(df, {"p0": own[0], "p1": own[1], "p2": own[2], "p3": Provider()}, "p")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    out = found.collect()
    assert len(out) == 60 and all(r.embedding[0] == r.id % 4 for r in out if r.p != "p3")
    assert all(len(r.embedding) == 64 for r in out if r.p == "p3")
    assert {r.embedding[1] for r in out if r.p != "p3"} == {4.0, 3.0}


@pytest.mark.parametrize("tasks", [1, 7])
def test_calls_are_consecutive_texts(spark, tasks):
    def function(texts):
        return [[float(i), float(len(texts)), float(texts[0][1:])] for i in range(len(texts))]

    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.floor(F.col("id") / 3).alias("n"),
                                  F.concat(F.lit("t"), F.floor(F.col("id") / 3).cast("string")).alias("document"))
    out = embed_in_order(df.repartition(tasks), ["g"], F.col("n"), Provider(batch_size=128, function=function)).collect()
    assert len(out) == 1000
    for r in out:
        size = {0: 334, 1: 333, 2: 333}[r.g]
        first = r.n // 128 * 128
        assert (r.batch_no, r.batch_pos, r.batch_texts) == (r.n // 128, r.n - first, min(128, size - first))
        assert list(r.embedding) == [r.batch_pos, r.batch_texts, first]
    with pytest.raises(Exception, match="NULL"):
        embed_in_order(df.withColumn("document", F.lit(None).cast("string")), ["g"], F.col("n"), Provider(function=function)).collect()
    with pytest.raises(ValueError):
        embed_in_order(df, ["g"], F.col("n"), Provider())
