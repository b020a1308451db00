"""Vectors kept by content: a text is sent to a provider's function once."""

import os

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from docquarry.operators.embedding import Provider
from docquarry.plans.jobs import index_documentation
from docquarry.session import list_names, rename_new
from docquarry.sources import vectors
from docquarry.sources.store import CollectionStore
from docquarry.sources.vectors import VectorCache


def recorder(folder, name="own", model="m", factor=1.0):
    """A function that writes down every text it gets, whichever process it runs in."""
    folder = str(folder)

    def function(texts):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
            file.write("\n".join(texts))
        return [[factor * len(text), 1.0] for text in texts]

    return Provider(name, model, 2, function=function)


def calls(folder):
    """The texts sent since the last look, in order."""
    sent = []
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        with open(path) as file:
            sent += file.read().split("\n")
        os.remove(path)
    return sorted(sent)


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return tmp_path / "log"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, document string").repartition(3)


def test_only_new_texts_are_sent(spark, tmp_path, log):
    cache, own = VectorCache(spark, str(tmp_path / "c")), recorder(log)
    first = ["a", "bb", "a", "a", "", None, "ccc"]
    rows = {r.i: r.embedding for r in cache.embed(frame(spark, first), own).collect()}
    assert rows == {i: [float(len(t)), 1.0] for i, t in enumerate(first) if t is not None}
    assert calls(log) == ["", "a", "bb", "ccc"]
    second = ["a", "dddd", "bb", "dddd"]
    rows = {r.i: r.embedding for r in cache.embed(frame(spark, second), own).collect()}
    assert rows == {i: [float(len(t)), 1.0] for i, t in enumerate(second)}
    assert calls(log) == ["dddd"]
    cache.embed(frame(spark, second), own).collect()
    assert calls(log) == [] and cache._version() == 2
    keys = [bytes(r.content_key) for r in cache.scan().collect()]
    assert len(keys) == len(set(keys)) == 5


def test_another_model_is_another_vector(spark, tmp_path, log):
    cache = VectorCache(spark, str(tmp_path / "c"))
    for number, provider in enumerate((recorder(log), recorder(log, model="n", factor=2.0), recorder(log, name="ow", model="nm", factor=3.0)), 1):
        assert cache.embed(frame(spark, ["aa"]), provider).first().embedding == [2.0 * number, 1.0]
        assert calls(log) == ["aa"]


def test_several_providers(spark, tmp_path, log):
    cache = VectorCache(spark, str(tmp_path / "c"))
    df = spark.createDataFrame([("x", "hashed"), ("y", "own"), ("y", "two"), ("y", "own")], "document string, p string")
    providers = {"hashed": Provider(dimension=3), "own": recorder(log), "two": recorder(log, "two", factor=5.0)}
    for sent in (["y", "y"], []):
        rows = sorted((r.p, r.embedding) for r in cache.embed(df, providers, "p").collect())
        assert [p for p, _ in rows] == ["hashed", "own", "own", "two"] and len(rows[0][1]) == 3
        assert [v for _, v in rows[1:]] == [[1.0, 1.0], [1.0, 1.0], [5.0, 1.0]]
        assert calls(log) == sent
    for wrong in ("nobody", None):
        bad = spark.createDataFrame([("x", wrong)], "document string, p string")
        with pytest.raises(SparkRuntimeException, match="no such provider"):
            cache.embed(bad, providers, "p").collect()


def test_frequent_and_rare_texts(spark, tmp_path, log, monkeypatch):
    monkeypatch.setattr(vectors, "FREQUENT", 4)
    texts = ["hot"] * 60 + [f"t{n}" for n in range(40)]
    cache, own = VectorCache(spark, str(tmp_path / "c")), recorder(log)
    rows = {r.i: r.embedding for r in cache.embed(frame(spark, texts), own).collect()}
    assert rows == {i: [float(len(t)), 1.0] for i, t in enumerate(texts)}
    assert calls(log) == sorted(set(texts))


def test_empty_input_and_clashing_columns(spark, tmp_path, log):
    cache, own = VectorCache(spark, str(tmp_path / "c")), recorder(log)
    assert cache.embed(frame(spark, ["a"]).limit(0), own).count() == 0 and cache._version() == 0
    given = frame(spark, ["a"]).withColumn("embedding", F.lit("old"))
    assert cache.embed(given, own).first().embedding == [1.0, 1.0]
    with pytest.raises(ValueError, match="content_key"):
        cache.embed(given.withColumn("content_key", F.lit(1)), own)


def test_a_failed_run_leaves_nothing(spark, tmp_path, log):
    cache = VectorCache(spark, str(tmp_path / "c"))
    broken = Provider("own", "m", 2, function=lambda texts: [[1.0, 2.0]] * 99, max_retries=0)
    with pytest.raises(Exception, match="asked for"):
        cache.embed(frame(spark, ["a", "b"]), broken)
    assert cache._version() == 0 and cache.scan().count() == 0
    assert cache.embed(frame(spark, ["a"]), recorder(log)).first().embedding == [1.0, 1.0]


def test_two_runs_at_once(spark, tmp_path, log, monkeypatch):
    """The slower one keeps what the faster did not add, calls nothing again, and no key occurs twice."""
    root = str(tmp_path / "c")
    cache, own, state = VectorCache(spark, root), recorder(log), {"other": True}

    def late(spark, source, target):
        if state.pop("other", False):
            VectorCache(spark, root).embed(frame(spark, ["a", "b"]), own)
        rename_new(spark, source, target)

    monkeypatch.setattr(vectors, "rename_new", late)
    rows = cache.embed(frame(spark, ["b", "c"]), own).collect()
    assert len(rows) == 2 and calls(log) == ["a", "b", "b", "c"]
    assert cache.scan().count() == 3 and cache._version() == 2
    assert [n for n in list_names(spark, root) if n.startswith("v")]


def test_second_index_run_embeds_changed_chunks_only(spark, tmp_path, log):
    projects = spark.createDataFrame([("p", "https://d.com/docs")], "project string, base_url string")

    def pages(text):
        link = '<a href="/docs/x">x</a>'
        return spark.createDataFrame(
            [("https://d.com/docs", f"<p>start</p>{link}"), ("https://d.com/docs/x", f"<p>{text}</p>")], "url string, html string")

    cache, own = VectorCache(spark, str(tmp_path / "c")), recorder(log)
    store = CollectionStore(spark, str(tmp_path / "s"))
    for text, sent in (("old", ["old", "start x"]), ("new text", ["new text"]), ("old", [])):
        index_documentation(projects, pages(text), store, own, cache=cache)
        assert calls(log) == sent
        assert {r.document: r.embedding for r in store.scan().collect()} == {
            t: [float(len(t)), 1.0] for t in ("start x", text)}
