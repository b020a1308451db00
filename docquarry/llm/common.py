"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHED_WORDS = 400_000
#: What a task does with its Arrow batches.
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key and text only, so that a scan reads two columns; null text is empty."""
    return docs.select(F.col(key).cast("bigint").alias(key),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weights(count: int) -> np.ndarray:
    """Fixed odd multipliers, one per place of a window."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def rows_in(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a slice of a batch at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            yield from zip(*(part.column(c).to_pylist() for c in columns))


def by_size(rows: Iterator[tuple], size, limit: int) -> Iterator[list[tuple]]:
    """Runs of rows whose sizes add up to about ``limit``."""
    run, total = [], 0
    for row in rows:
        run.append(row)
        total += size(row)
        if total >= limit:
            yield run
            run, total = [], 0
    if run:
        yield run


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Batches) -> Batches:
    """A task's function that gives memory back at its end.

    Workers outlive their tasks: as many as the stage with most Python steps had stay beside the JVM and take turns
    in later stages, each with what it did not give back.
    """
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()
    return tidied
