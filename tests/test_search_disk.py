"""What a search and the building of its collection keep on disk."""

import os
import random

from pyspark.sql import functions as F

from docquarry.operators import knn
from docquarry.plans import inputs
from docquarry.plans.jobs import search_docs
from docquarry.session import release, scratch_root
from docquarry.sources.store import CollectionStore
from tests.test_search_at_scale import QUERY, answers, asked, stored


def kept(spark):
    """Names of the tables in the shared folder."""
    root = f"{scratch_root(spark)}/docquarry"
    return {(one, name) for one in (os.listdir(root) if os.path.isdir(root) else ()) for name in os.listdir(f"{root}/{one}")}


def shuffled(spark):
    """Bytes of shuffle files on disk."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(os.path.getsize(f"{at}/{f}") for d in dirs for at, _, files in os.walk(d) for f in files if f.startswith("shuffle_"))


def in_rounds(monkeypatch, seen=lambda: None):
    """Rounds of a block or two; ``seen`` is called as each begins."""
    made = []

    def each(frames, name, whole=knn.stage_in_turn):
        def began():
            for df in frames:
                made.append(seen())
                yield df
                del df
        return whole(began(), name)

    monkeypatch.setattr(knn, "ROUND_BYTES", 1)
    monkeypatch.setattr(knn, "ROUND_SHARE", 0.01)
    monkeypatch.setattr(knn, "stage_in_turn", each)
    return made


def test_rounds_give_the_rows_of_one_job(spark, monkeypatch):
    """Also of queries that repeat an id with other vectors, whose answers are merged."""
    rng = random.Random(12)
    records = stored(spark, rng, hot=700, tiny=3)
    more = [(q, "hot", [rng.gauss(0, 1) for _ in range(8)], 3) for q in [9000, 9001] * 20]
    queries = asked(spark, rng, hot=100, tiny=9, none=4).union(spark.createDataFrame(more, QUERY)).repartition(4)
    monkeypatch.setattr(knn, "PART_BYTES", 40_000)
    job = answers(knn.knn_batch(queries, records, block_bytes=10_000))
    assert len(job) == 100 * 3 + 9 * 3 + 2 * 3
    made = in_rounds(monkeypatch)
    assert answers(knn.knn_batch(queries, records, block_bytes=10_000)) == job
    assert len(made) >= 3


def test_the_shuffle_of_a_round_goes_before_the_next(spark, monkeypatch):
    rng = random.Random(13)
    records, queries = stored(spark, rng, hot=2000), asked(spark, rng, hot=600)
    monkeypatch.setattr(knn, "PART_BYTES", 32_000)
    release(spark)
    held = shuffled(spark)
    whole = answers(knn.knn_batch(queries, records, block_bytes=30_000))
    at_once = shuffled(spark) - held
    release(spark)
    held = shuffled(spark)
    made = in_rounds(monkeypatch, lambda: shuffled(spark) - held)
    assert answers(knn.knn_batch(queries, records, block_bytes=30_000)) == whole
    assert len(made) > 4 and max(made) < at_once / 4


def test_only_winners_outlive_a_search(spark, tmp_path):
    rng = random.Random(14)
    store = CollectionStore(spark, str(tmp_path / "store"))
    store.write(stored(spark, rng, hot=50).withColumns({"page_url": F.lit("u"), "chunk_pos": F.lit(0)}))
    queries = asked(spark, rng, hot=5, missing=2).select(
        "query_id", "collection_name", F.lit(None).cast("string").alias("query_text"), F.col("vector").alias("query_embedding"), "top_k")
    before = kept(spark)
    found = search_docs(queries, store.scan(), contracts=store.contracts())
    assert sorted(name for _, name in kept(spark) - before) == ["nearest", "refused"]
    assert found.groupBy("error").count().orderBy("error").collect() == [(None, 15), ("unknown_collection", 2)]


def test_only_the_store_outlives_its_building(spark, tmp_path):
    rows = [(i, f"word{i % 7} " * (i % 900), "s") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    before = kept(spark)
    store = inputs.document_store(spark, str(tmp_path))
    assert [name for _, name in kept(spark) - before] == ["store"]
    chunks = sum(-(-(i % 900) // 500) for i in range(40))
    assert sorted(int(r.id) for r in store.scan().select("id").collect()) == list(range(chunks))
