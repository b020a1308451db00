"""Removal of long byte strings that occur more than once.

Every string of ``length`` bytes is judged by a sampled suffix inside it. Suffixes are sampled by
content, so that two equal strings are always sampled at the same offset: one sampled suffix
speaks for all copies, as a difference cover gives a common offset to each pair. A sampled suffix
serves the run of strings around it for which it is the first sample past their first ``WINDOW``
bytes. Its *core* is what all strings of the run share, its *full* is what they cover together.

* Sampled suffixes are named by their core; only names that occur again go on.
* Those are named again by their full; equal fulls are repeated with all their strings.
* Where a core has several fulls, the remaining suffixes are merged through the sample: each
  string of the run is named itself, once per full, and compared with those of the other fulls.

Names are 64-bit hashes, compared by grouping, so groups of any size are pre-aggregated. The
named method sorts byte triples instead; README.md says why that is not done here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.anchors import WINDOW, anchors
from docquarry.llm.bitmap import Bitmap
from docquarry.llm.common import batch_of, rows_in, tidy
from docquarry.session import scope, stage

LENGTH = 400
FLUSH = 500_000
SEEN = 200_000


def _name(data: memoryview) -> int:
    return xxhash.xxh3_64_intdigest(data)


def runs_of(data: bytes, length: int) -> Iterator[tuple[int, int, int]]:
    """First and last start of the strings that each sampled suffix serves, and where its core starts.

    A core has ``length - WINDOW + 1`` bytes, wherever the strings that are served start.
    """
    end, before = len(data) - length, None
    if end < 0:
        return
    for at in anchors(np.frombuffer(data, dtype=np.uint8)).tolist():
        low = 0 if before is None else max(0, before - WINDOW + 2)
        high = min(at - WINDOW + 1, end)
        before = at
        if low <= high:
            yield low, high, at - WINDOW + 1


def _core_names(view: memoryview, served: list[tuple[int, int, int]], length: int) -> list[int]:
    return [_name(view[at:at + length - WINDOW + 1]) for _, _, at in served]


def _cores(length: int):
    schema = pa.schema([("core", pa.int64()), ("n", pa.int64())])

    def flush(held: list[int]) -> pa.RecordBatch:
        core, n = np.unique(np.array(held, dtype=np.uint64), return_counts=True)
        return batch_of(schema, core.view(np.int64), n.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        for (text,) in rows_in(batches, "text"):
            data = text.encode()
            held.extend(_core_names(memoryview(data), list(runs_of(data, length)), length))
            if len(held) >= FLUSH:
                yield flush(held)
                held = []
        if held:
            yield flush(held)

    return run


def _named(length: int, shared):
    schema = pa.schema([("core", pa.int64()), ("full", pa.int64()), ("text_key", pa.int64()),
                        ("low", pa.int32()), ("high", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = shared.value
        out, held = [], 0
        for key, text in rows_in(batches, "text_key", "text"):
            data = text.encode()
            view = memoryview(data)
            served = list(runs_of(data, length))
            core = np.array(_core_names(view, served, length), dtype=np.uint64)
            kept = np.flatnonzero(repeated.holds(core))
            if not len(kept):
                continue
            low, high, _ = np.array(served, dtype=np.int32)[kept].T
            full = np.array([_name(view[a:b + length]) for a, b in zip(low.tolist(), high.tolist())], dtype=np.uint64)
            out.append((core[kept].view(np.int64), full.view(np.int64), np.full(len(kept), key), low, high))
            held += len(kept)
            if held >= 100_000:
                yield batch_of(schema, *map(np.concatenate, zip(*out)))
                out, held = [], 0
        if out:
            yield batch_of(schema, *map(np.concatenate, zip(*out)))

    return run


def _windows(length: int):
    schema = pa.schema([("name", pa.int64()), ("full", pa.int64()), ("text_key", pa.int64()),
                        ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, fulls, keys, starts = [], [], [], []
        for key, text, runs in rows_in(batches, "text_key", "text", "runs"):
            view = memoryview(text.encode())
            for r in runs:
                span = range(r["low"], r["high"] + 1)
                names.extend(_name(view[i:i + length]) for i in span)
                fulls.extend([r["full"]] * len(span))
                keys.extend([key] * len(span))
                starts.extend(span)
            if len(names) >= 100_000:
                yield batch_of(schema, np.array(names, dtype=np.uint64).view(np.int64), fulls, keys, starts)
                names, fulls, keys, starts = [], [], [], []
        if names:
            yield batch_of(schema, np.array(names, dtype=np.uint64).view(np.int64), fulls, keys, starts)

    return run


def _rows_held(shared, held: bool):
    """Whole rows whose text key the bitmap may hold, or surely does not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                mask = shared.value.holds(part.column("__text_key").to_numpy()) == held
                if mask.any():
                    yield part.filter(pa.array(mask))
    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``text_key, spans`` per distinct text with repeats: sorted, disjoint ``(low, high)`` byte ranges.

    ``text_key`` is ``xxhash64`` of the text. Texts are scanned three times and never shuffled, but for
    those that hold a string to be compared one by one.
    """
    with scope(docs.sparkSession):
        return stage(_spans(docs, length), "spans", keep=True)


def _spans(docs: DataFrame, length: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    source = _keyed(docs)
    repeated = source.select("text").mapInArrow(tidy(_cores(length)), "core bigint, n bigint").groupBy("core").agg(
        F.sum("n").alias("n")).where("n > 1").select("core")
    shared = context.broadcast(Bitmap(repeated))
    named = stage(source.mapInArrow(
        tidy(_named(length, shared)), "core bigint, full bigint, text_key bigint, low int, high int"), "named")
    fulls = stage(named.groupBy("full").agg(
        F.count("*").alias("n"), F.min("core").alias("core"),
        F.min(F.struct("text_key", "low", "high")).alias("at")), "fulls")
    whole = named.join(fulls.where("n > 1").select("full"), "full").select(
        "text_key", "low", (F.col("high") + length).alias("high"))
    mixed = fulls.groupBy("core").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where(
        "kinds > 1 and least = 1").select("core")
    chosen = stage(fulls.join(mixed, "core").groupBy("at.text_key").agg(
        F.collect_list(F.struct("at.low", "at.high", "full")).alias("runs")), "chosen")
    of_runs = context.broadcast(Bitmap(chosen.select("text_key")))
    bearing = source.withColumn("__text_key", F.col("text_key")).mapInArrow(
        tidy(_rows_held(of_runs, True)), "text_key bigint, text string, __text_key bigint").dropDuplicates(["text_key"])
    windows = stage(bearing.join(chosen, "text_key").select("text_key", "text", "runs").mapInArrow(
        tidy(_windows(length)), "name bigint, full bigint, text_key bigint, start int"), "windows")
    again = windows.groupBy("name").agg(F.min("full").alias("a"), F.max("full").alias("b")).where("a <> b").select("name")
    single = windows.join(again, "name").select(
        "text_key", F.col("start").alias("low"), (F.col("start") + length).alias("high"))
    spans = whole.union(single).groupBy("text_key", "low").agg(F.max("high").alias("high"))
    merged = F.aggregate(
        F.array_sort(F.collect_list(F.struct("low", "high"))),
        F.expr("cast(array() as array<struct<low:int,high:int>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["high"] >= s["low"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["low"].alias("low"),
                F.greatest(F.element_at(done, -1)["high"], s["high"]).alias("high")))),
        ).otherwise(F.concat(done, F.array(F.struct(s["low"].alias("low"), s["high"].alias("high"))))),
    )
    return spans.groupBy("text_key").agg(merged.alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("text_key"), text.alias("text"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All rows and columns of ``docs``, with ``kept`` (binary), ``n_removed`` and ``n_spans``.

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of ``length`` bytes covers it that also
    starts anywhere else, in the same text or another; strings never cross texts, and are judged on the
    input. So of a passage that occurs twice no copy stays. ``n_spans`` counts maximal removed runs. Repeated
    rows are copies of one another and all stay as rows. Texts shorter than ``length`` are never changed. An empty table
    gives no rows. Columns named like the new ones are replaced. Only rows whose text has repeats are shuffled.
    """
    spans = repeated_spans(docs, length)
    shared = docs.sparkSession.sparkContext.broadcast(Bitmap(spans.select("text_key")))
    own = docs.drop("kept", "n_removed", "n_spans")
    keyed = own.withColumn("__text_key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    untouched = keyed.mapInArrow(tidy(_rows_held(shared, False)), keyed.schema).withColumns({
        "kept": raw, "n_removed": F.lit(0).cast("bigint"), "n_spans": F.lit(0).cast("bigint")})
    touched = keyed.mapInArrow(tidy(_rows_held(shared, True)), keyed.schema).join(
        spans.withColumnRenamed("text_key", "__text_key").withColumnRenamed("spans", "__spans"), "__text_key", "left")
    span = F.coalesce("__spans", F.expr("cast(array() as array<struct<low:int,high:int>>)"))
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0)), span["high"]), F.concat(span["low"], F.array(F.octet_length(raw))),
        lambda low, high: F.substring(raw, low + 1, high - low))
    touched = touched.withColumns({
        "kept": F.aggregate(gaps, F.lit(b""), lambda done, part: F.concat(done, part)),
        "n_removed": F.aggregate(span, F.lit(0).cast("bigint"), lambda n, s: n + s["high"] - s["low"]),
        "n_spans": F.size(span).cast("bigint"),
    })
    columns = [*own.columns, "kept", "n_removed", "n_spans"]
    return untouched.select(columns).union(touched.select(columns))
