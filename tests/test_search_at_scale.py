"""Blocks of queries against parts of a collection, the fetch of winners, and the search in cells."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docquarry.operators import cells, knn
from tests.plans import no_broadcast, shuffled_columns

RECORD = "collection_name string, id string, document string, embedding array<float>, metadata map<string,string>"
QUERY = "query_id long, collection_name string, vector array<float>, top_k int"


def vectors(rng, n, size=8):
    return [[rng.gauss(0, 1) for _ in range(size)] for _ in range(n)]


def stored(spark, rng, **collections):
    rows = [(name, str(i), f"text {name} {i}", v, {"source": name})
            for name, n in collections.items() for i, v in enumerate(vectors(rng, n))]
    return spark.createDataFrame(rows, RECORD).repartition(4)


def asked(spark, rng, **collections):
    rows = [(hash_id, name, v, 3) for name, n in collections.items()
            for hash_id, v in zip(range(1000 * len(name), 1000 * len(name) + n), vectors(rng, n))]
    return spark.createDataFrame(rows, QUERY)


def answers(df):
    return sorted((r.query_id, r["rank"], r.collection_name, r.id, r.distance) for r in df.collect())


def test_any_number_of_blocks_gives_the_same_rows(spark, monkeypatch):
    rng = random.Random(2)
    records, queries = stored(spark, rng, hot=900, tiny=3), asked(spark, rng, hot=200, tiny=9, none=4)
    whole = answers(knn.knn_batch(queries, records))
    assert len(whole) == 200 * 3 + 9 * 3
    each = 8 * 8 + 3 * 64 + 64
    for blocks in (1, 4, 40):
        for part_bytes in (knn.PART_BYTES, 20_000):
            monkeypatch.setattr(knn, "PART_BYTES", part_bytes)
            found = knn.knn_batch(queries, records, block_bytes=math.ceil(213 * each / blocks) if blocks > 1 else 1 << 30)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FlatMapCoGroupsInArrow") == (0 if blocks == 1 else 1)
            assert "Union" not in plan
            assert answers(found) == whole


def test_repeated_queries_and_records(spark):
    """Rows that repeat an id spread over tasks and are answered, or offered, one by one."""
    rng = random.Random(3)
    records = stored(spark, rng, hot=50)
    queries = asked(spark, rng, hot=1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n")
    grid = knn.knn_batch(queries, records, block_bytes=10_000)
    assert grid.select("query_id", "rank").distinct().count() == 3


def test_only_winners_leave_the_scan(spark, tmp_path):
    rng = random.Random(4)
    stored(spark, rng, hot=3000).write.parquet(str(tmp_path / "r"))
    records = spark.read.schema(RECORD).parquet(str(tmp_path / "r"))
    found = knn.search(asked(spark, rng, hot=5), records)
    assert {r.document for r in found.collect()} == {f"text hot {r.id}" for r in found.collect()}
    with no_broadcast(spark):
        plan = knn.search(asked(spark, rng, hot=5), records)._jdf.queryExecution().executedPlan().toString()
        assert plan.index("BroadcastHashJoin") > plan.index("SortMergeJoin")
        passed = knn.maybe_in(records, ["collection_name", "id"], found.select("collection_name", "id").distinct())
        assert passed.count() < 400
        assert all("document" not in c for c in shuffled_columns(passed))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_all_cells_probed_is_exact(spark, tmp_path, metric):
    rng = random.Random(5)
    records, queries = stored(spark, rng, a=400, b=90), asked(spark, rng, a=40, bb=0, b=7)
    cells.write_cells(records, str(tmp_path / "c"), 12, metric)
    assert cells.scan_cells(spark, str(tmp_path / "c")).count() == 490
    every = cells.search_cells(queries, str(tmp_path / "c"), 12)
    assert answers(every) == answers(knn.knn_batch(queries, records, metric))


def test_recall_and_pruning(spark, tmp_path):
    """Vectors in loose clumps: a quarter of the cells finds nine tenths, and other folders are not read."""
    rng = random.Random(6)
    middles = vectors(rng, 20, 16)
    rows = [("all", str(i), "d", [x + rng.gauss(0, 0.4) for x in middles[i % 20]], {}) for i in range(2000)]
    records = spark.createDataFrame(rows, RECORD)
    queries = records.select(F.col("id").cast("long").alias("query_id"), "collection_name", F.col("embedding").alias("vector"),
                             F.lit(10).alias("top_k"))
    path = str(tmp_path / "c")
    cells.write_cells(records, path, 32)
    found = cells.recall(cells.search_cells(queries, path, 8), knn.knn_batch(queries, records)).first()
    assert found.queries == 2000 and found.recall >= 0.9
    near = cells.scan_cells(spark, path).where(F.col("cell").isin([1, 2])).select("id")
    assert "PartitionFilters: [isnotnull(cell" in near._jdf.queryExecution().executedPlan().toString() or \
        "PartitionFilters: [cell" in near._jdf.queryExecution().executedPlan().toString()


def test_odd_indexes(spark, tmp_path):
    path = str(tmp_path / "c")
    nan = float("nan")
    some = spark.createDataFrame([("a", "1", "d", [1.0, 2.0], {}), ("a", "2", "d", [nan, 2.0], {}), ("a", "3", "d", None, {}),
                                  ("a:b", "4", "d", [1.0, 2.5], {})], RECORD)
    cells.write_cells(some, path, 5)
    queries = spark.createDataFrame([(1, "a", [1.0, 2.0], 9), (2, "a:b", [0.0, 0.0], None), (3, "a", [1.0], 2),
                                     (4, "a", [nan, 1.0], 2), (5, "a", None, 2)], QUERY)
    assert [r[:4] for r in answers(cells.search_cells(queries, path))] == [(1, 1, "a", "1"), (2, 1, "a:b", "4")]
    cells.write_cells(some.limit(0), path, 5)
    assert cells.search_cells(queries, path).count() == 0
    with pytest.raises(ValueError, match="1 to 2"):
        cells.write_cells(some.union(spark.createDataFrame([("a", "9", "d", [1.0], {})], RECORD)), path)
    with pytest.raises(ValueError, match="metrics"):
        cells.write_cells(some, path, metric="ip")


def test_work_of_a_task_is_bounded(spark, monkeypatch):
    """Few bytes but much work are cut into tasks too, with a partition for each."""
    rng = random.Random(7)
    records, queries = stored(spark, rng, hot=600), asked(spark, rng, hot=200)
    whole = answers(knn.knn_batch(queries, records))
    monkeypatch.setattr(knn, "CELL_WORK", 200 * 600 * 8 // 40)
    found = knn.knn_batch(queries, records, block_bytes=1 << 12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = {int(n) for n in re.findall(r"hashpartitioning\(collection_name#\d+, length#\d+, block#\d+L?, part#\d+L?, (\d+)\)", plan)}
    assert len(dealt) == 1 and dealt.pop() >= 40
    assert answers(found) == whole


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
@pytest.mark.parametrize("block_bytes", [knn.QUERY_BLOCK_BYTES, 1_000])
def test_copies_sizes_and_close_calls(spark, metric, block_bytes):
    """Many copies of one vector, numbers beyond single precision, and distances that single precision cannot tell apart."""
    rng = random.Random(8)
    base = [rng.gauss(0, 1) for _ in range(8)]
    rows = [("a", f"c{i:04}", base) for i in range(3000)] + [("a", f"n{i:04}", [x + i * 1e-7 for x in base]) for i in range(60)]
    rows += [("b", f"b{i:03}", [rng.gauss(0, 1) * 1e20 for _ in range(8)]) for i in range(90)]
    rows += [("c", f"s{i:03}", [rng.gauss(0, 1) * 1e-22 for _ in range(8)]) for i in range(90)]
    records = spark.createDataFrame(rows, "collection_name string, id string, embedding array<double>").repartition(3)
    wanted = [(n, name, next(v for c, _, v in rows[::-1] if c == name), 7) for n, name in enumerate("abc")]
    wanted += [(9, "a", base, 4), (10, "b", [0.0] * 8, 5)]
    queries = spark.createDataFrame(wanted, QUERY.replace("float", "double"))
    found = answers(knn.knn_batch(queries, records, metric, block_bytes if block_bytes > 1_000 else 200))
    for query, name, vector, k in wanted:
        one = [(r.id, r.distance) for r in knn.knn(records.where(F.col("collection_name") == name), vector, k, metric).collect()]
        assert [(i, d) for q, _, _, i, d in found if q == query] == one
