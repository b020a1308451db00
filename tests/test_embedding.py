import hashlib
import math
import struct

import pytest
from pyspark.errors import PythonException, SparkRuntimeException
from pyspark.sql import functions as F

from docquarry.operators.embedding import (
    Provider, _batched, embed, embed_by_provider, hashed_words, require_valid, validate_embeddings,
)


def model(text, dimension=64):
    counts = [0] * dimension
    for word in text.split():
        counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimension] += 1
    norm = math.sqrt(sum(n * n for n in counts))
    return [struct.unpack("f", struct.pack("f", n / norm if norm else 0.0))[0] for n in counts]


def test_hashed_vectors(spark):
    texts = ["", "a", "the cat the dog", "é  ü\tß", " ".join(f"w{i}" for i in range(700))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, document string")
    for dimension in (64, 7):
        rows = embed(df, Provider(dimension=dimension)).collect()
        assert {r.i: r.embedding for r in rows} == {
            i: model(t, dimension) for i, t in enumerate(texts)}


def test_hashed_words_equal_the_columns(spark):
    """Found per distinct word in Arrow batches, vectors are those of the column functions for any text."""
    from docquarry.functions.text import raw_words
    from docquarry.functions.vectors import hashed_vector

    odd = ["", None, " \t", "a\u2003b\x1cc\u200bd", "x\x85y\u3000z", "ü 😀 ü", "w " * 900, "a\x00b \x00"]
    df = spark.createDataFrame([(t,) for t in odd], "t string").union(spark.sql("select cast(x'61FF6220E282' as string)"))
    both = df.select(hashed_words("t", 9).alias("a"), hashed_vector(raw_words(F.col("t")), 9).alias("b"))
    rows = both.collect()
    assert len(rows) == 9 and all(r.a == r.b for r in rows)
    plan = embed(df, Provider(), "t")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "md5" not in plan


def batches_of(sizes):
    import pyarrow as pa

    start = 0
    for size in sizes:
        yield pa.RecordBatch.from_pydict(
            {"i": list(range(start, start + size)),
             "document": [f"t{k}" for k in range(start, start + size)]})
        start += size


@pytest.mark.parametrize("arrow, calls", [
    ([], []), ([0], []), ([1], [1]), ([128], [128]), ([129], [128, 1]),
    ([100, 100, 100], [128, 128, 44]), ([1] * 130, [128, 2]),
])
def test_calls_hold_128_texts(arrow, calls):
    seen = []

    def function(texts):
        seen.append(len(texts))
        return [[float(t[1:])] for t in texts]

    out = list(_batched(Provider(function=function), "document", "v")(batches_of(arrow)))
    assert seen == calls
    rows = [(i, v) for b in out for i, v in zip(b["i"].to_pylist(), b["v"].to_pylist())]
    assert rows == [(i, [float(i)]) for i in range(sum(arrow))]


@pytest.mark.parametrize("failures, error", [(0, False), (3, False), (4, True)])
def test_retry_with_growing_delays(failures, error):
    waits, left = [], [failures]

    def function(texts):
        if left[0]:
            left[0] -= 1
            raise ConnectionError("no")
        return [[0.0] for _ in texts]

    provider = Provider(function=function, sleep=waits.append)
    run = _batched(provider, "document", "v")(batches_of([2]))
    if error:
        with pytest.raises(ConnectionError):
            list(run)
    else:
        assert sum(b.num_rows for b in run) == 2
    assert waits == [1.0, 2.0, 4.0][:failures]


def test_function_runs_in_tasks_and_keeps_columns(spark):
    df = spark.range(1000).select("id", F.concat(F.lit("t"), F.col("id")).alias("document"))
    provider = Provider(function=lambda texts: [[float(t[1:]), 1.0] for t in texts], dimension=2)
    rows = embed(df.repartition(5), provider.with_batch_size(7)).collect()
    assert sorted((r.id, r.embedding) for r in rows) == [(i, [float(i), 1.0]) for i in range(1000)]


def test_wrong_number_of_vectors_fails(spark):
    df = spark.createDataFrame([("a",), ("b",)], "document string").coalesce(1)
    with pytest.raises(PythonException, match="asked for 2 vectors"):
        embed(df, Provider(function=lambda texts: [[1.0]])).collect()


def test_inputs_are_checked(spark):
    with pytest.raises(TypeError):
        embed(spark.range(1), Provider(), "id")
    df = spark.createDataFrame([("a",), (None,)], "document string")
    assert embed(df, Provider()).count() == 1


def test_choice_of_provider(spark):
    df = spark.createDataFrame([("x", "hashed"), ("y", "own")], "document string, p string")
    providers = {"hashed": Provider(dimension=2), "own": Provider(function=lambda ts: [[9.0] for _ in ts])}
    rows = {r.document: r.embedding for r in embed_by_provider(df, providers, "p").collect()}
    assert rows["y"] == [9.0] and len(rows["x"]) == 2
    with pytest.raises(SparkRuntimeException, match="no such provider"):
        embed_by_provider(df, {"own": providers["own"]}, "p").collect()


def test_validation(spark):
    df = spark.createDataFrame(
        [("c", [1.0, 2.0]), ("c", [1.0]), ("c", None)], "g string, embedding array<float>")
    row = validate_embeddings(df, "g", 2).first()
    assert (row.records, row.missing, row.wrong_size, row.valid) == (3, 1, 1, 1)
    with pytest.raises(SparkRuntimeException, match="vector of 2 numbers"):
        require_valid(df, 2).collect()
