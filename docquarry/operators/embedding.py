"""Text to vectors: a built-in hashed provider and any user function."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.vectors import HASH_DIMENSION, finite

BATCH_SIZE = 128
MAX_RETRIES = 3
BACKOFF_SECONDS = 1.0
KEPT_WORDS = 400_000


@dataclass(frozen=True)
class Provider:
    """How a text becomes a vector.

    ``function`` maps a list of texts to a list of vectors, in order. Without one, the
    hashed word counts of this package are used.
    """

    name: str = "hashed"
    model: str = "hashed-words"
    dimension: int | None = HASH_DIMENSION
    batch_size: int = BATCH_SIZE
    function: Callable[[list[str]], list[list[float]]] | None = None
    max_retries: int = MAX_RETRIES
    backoff_seconds: float = BACKOFF_SECONDS
    sleep: Callable[[float], None] = time.sleep

    def info(self) -> dict:
        return {"name": self.name, "model": self.model, "batch_size": self.batch_size}

    def with_batch_size(self, batch_size: int) -> Provider:
        return replace(self, batch_size=batch_size)


def provider_info(df: DataFrame, provider: Provider) -> DataFrame:
    """Put the description of the provider next to each row."""
    info = provider.info()
    return df.select(
        "*",
        F.lit(info["name"]).alias("provider_name"),
        F.lit(info["model"]).alias("provider_model"),
        F.lit(info["batch_size"]).alias("provider_batch_size"),
    )


def described(choice: Column | None, providers: Provider | dict[str, Provider]) -> dict[str, Column]:
    """``provider_name``, ``provider_model`` and ``provider_batch_size`` of the provider of a row: the only one, or that named by ``choice``."""
    if isinstance(providers, Provider):
        return {f"provider_{key}": F.lit(value) for key, value in providers.info().items()}
    found = {}
    for key in ("name", "model", "batch_size"):
        pairs = [F.lit(part) for name, p in providers.items() for part in (name, p.info()[key])]
        found[f"provider_{key}"] = F.try_element_at(F.create_map(*pairs), choice)
    return found


def require_text_column(df: DataFrame, column: str) -> None:
    found = df.schema[column].dataType
    if not isinstance(found, T.StringType):
        raise TypeError(f"column {column} must be a string, not {found.simpleString()}")


def input_error(column: Column) -> Column:
    """Why a text cannot be embedded; NULL when it can."""
    return F.when(column.isNull(), F.lit("text_is_null"))


def hashed_words(column: str, dimension: int = HASH_DIMENSION) -> Column:
    """``hashed_vector`` of the ``raw_words`` of a text; a word's bucket is found once per task, up to a bounded number of words."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from hashlib import md5

        import numpy as np

        class Buckets(dict):
            def __missing__(self, word):
                if len(self) >= KEPT_WORDS:
                    self.clear()
                value = self[word] = int.from_bytes(md5(word.encode()).digest()[:4], "big") % dimension
                return value

        bucket = Buckets().__getitem__
        for texts in batches:
            texts, made = texts.cast(pa.binary()), []
            for start in range(0, len(texts), 512) or [0]:
                part = texts.slice(start, 512).to_pylist()
                counts = np.zeros((len(part), dimension))
                for row, text in enumerate(part):
                    words = (text or b"").decode("utf-8", "replace").split()
                    counts[row] = np.bincount(np.fromiter(map(bucket, words), "int64", len(words)), minlength=dimension)
                norm = np.sqrt((counts * counts).sum(axis=1))[:, None]
                vectors = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0).astype("float32")
                empty = np.array([text is None for text in part], bool)
                ends = np.arange(len(part) + 1, dtype="int32") * dimension
                made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel()), mask=pa.array(empty)))
            yield pa.concat_arrays(made)

    return F.arrow_udf(of, "array<float>")(F.col(column))


def embed(df: DataFrame, provider: Provider, column: str = "document",
          out: str = "embedding") -> DataFrame:
    """Add the vector of ``column``; rows without text are left out."""
    require_text_column(df, column)
    given = df.where(input_error(F.col(column)).isNull())
    if provider.function is None:
        vector = hashed_words(column, provider.dimension)
        return given.withColumn(out, vector)
    schema = T.StructType([*given.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    return given.mapInArrow(_batched(provider, column, out), schema)


def _caller(provider: Provider):
    """Task-side call of a provider's function, tried again after growing delays; its answer is checked."""
    function, retries, backoff, sleep = provider.function, provider.max_retries, provider.backoff_seconds, provider.sleep

    def call(texts):
        for attempt in range(retries + 1):
            try:
                vectors = function(texts)
                break
            except Exception:
                if attempt == retries:
                    raise
                sleep(backoff * 2**attempt)
        if len(vectors) != len(texts):
            raise RuntimeError(f"asked for {len(texts)} vectors, got {len(vectors)}")
        if len({len(v) for v in vectors}) > 1:
            raise RuntimeError("vectors of different lengths")
        return [list(v) for v in vectors]

    return call


def _batched(provider: Provider, column: str, out: str):
    """Task-side loop: calls of exactly ``batch_size`` texts, the last of a task smaller."""
    return _batched_by({None: provider}, None, column, out)


def _batched_by(providers: dict, choice: str | None, column: str, out: str):
    """``_batched`` for several providers: each gets full calls of the rows that name it in ``choice``."""
    calls = {name: _caller(p) for name, p in providers.items()}
    sizes = {name: p.batch_size for name, p in providers.items()}

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def finish(name, table):
            vectors = pa.array(calls[name](table.column(column).to_pylist()), pa.list_(pa.float32()))
            return table.append_column(out, vectors).combine_chunks().to_batches()

        waiting: dict = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for name in calls:
                own = table if choice is None else table.filter(pc.equal(table.column(choice), name))
                if not own.num_rows:
                    continue
                held = pa.concat_tables([waiting[name], own]) if name in waiting else own
                while held.num_rows >= sizes[name]:
                    yield from finish(name, held.slice(0, sizes[name]))
                    held = held.slice(sizes[name])
                waiting[name] = held
        for name, held in waiting.items():
            if held.num_rows:
                yield from finish(name, held)

    return run


def embed_by_provider(df: DataFrame, providers: dict[str, Provider], choice: str,
                      column: str = "document", out: str = "embedding") -> DataFrame:
    """Embed each row with the provider named in its ``choice`` column; rows without text are left out.

    All functions are called in one pass of the rows, so that what comes before is computed once for them; providers
    without a function share another, in which none is called. A row whose provider is not given fails the job rather
    than vanish.
    """
    require_text_column(df, column)
    known = F.col(choice).isin(list(providers))
    unknown = F.raise_error(F.concat(F.lit("no such provider: "), F.coalesce(choice, F.lit("NULL"))))
    checked = df.withColumn(choice, F.when(known, F.col(choice)).otherwise(unknown.cast("string"))).where(
        input_error(F.col(column)).isNull())
    called = {name: p for name, p in providers.items() if p.function is not None}
    plain = {name: p for name, p in providers.items() if p.function is None}
    parts = []
    if plain:
        vector = F.lit(None).cast("array<float>")
        for name, provider in plain.items():
            vector = F.when(F.col(choice) == name, hashed_words(column, provider.dimension)).otherwise(vector)
        own = checked.where(F.col(choice).isin(list(plain))) if called else checked
        parts.append(own.withColumn(out, vector))
    if called:
        own = checked.where(F.col(choice).isin(list(called))) if plain else checked
        schema = T.StructType([*own.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
        parts.append(own.mapInArrow(_batched_by(called, choice, column, out), schema))
    return reduce(DataFrame.unionByName, parts)


def embed_in_order(numbered: DataFrame, group: list[str], number: Column, provider: Provider,
                   column: str = "document", out: str = "embedding") -> DataFrame:
    """``embed`` whose calls are the same however tasks fall: ``batch_size`` consecutive texts of a group, by ``number``.

    ``number`` counts the rows of a group from 0 without gaps; rows without text are refused, since they would leave
    some. Adds ``batch_no`` and, as really sent, ``batch_pos`` and ``batch_texts``: the place of a text in its call and how many
    texts that had. The texts of a call travel to one task; without need for the same calls, ``embed`` moves none.
    """
    require_text_column(numbered, column)
    if provider.function is None:
        raise ValueError("a provider without a function makes no calls")
    filled = F.coalesce(F.col(column), F.raise_error(F.lit("a text is NULL")).cast("string"))
    keyed = numbered.withColumns({column: filled, "_number": number}).withColumn(
        "batch_no", F.floor(F.col("_number") / provider.batch_size))
    keys = [*group, "batch_no"]
    dealt = keyed.repartition(*keys).sortWithinPartitions(*keys, "_number")
    schema = T.StructType([*dealt.schema.fields, T.StructField("batch_pos", T.IntegerType()),
                           T.StructField("batch_texts", T.IntegerType()),
                           T.StructField(out, T.ArrayType(T.FloatType()))])
    return dealt.mapInArrow(_in_order(provider, keys, column, out), schema).drop("_number")


def _in_order(provider: Provider, keys: list[str], column: str, out: str):
    """Task-side loop over rows sorted by call: one call as soon as the next one begins."""
    call = _caller(provider)

    def run(batches):
        import pyarrow as pa

        def finish(tables):
            table = pa.concat_tables(tables).combine_chunks()
            count = table.num_rows
            vectors = call(table.column(column).to_pylist())
            table = table.append_column("batch_pos", pa.array(range(count), pa.int32()))
            table = table.append_column("batch_texts", pa.array([count] * count, pa.int32()))
            return table.append_column(out, pa.array(vectors, pa.list_(pa.float32()))).combine_chunks().to_batches()

        waiting, open_key = [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = list(zip(*(table.column(k).to_pylist() for k in keys)))
            start = 0
            for end in range(1, len(names) + 1):
                if end < len(names) and names[end] == names[start]:
                    continue
                if waiting and names[start] != open_key:
                    yield from finish(waiting)
                    waiting = []
                waiting.append(table.slice(start, end - start))
                open_key, start = names[start], end
        if waiting:
            yield from finish(waiting)

    return run


def batch_plan(numbered: DataFrame, group: list[str], number: Column,
               batch_size: int = BATCH_SIZE) -> DataFrame:
    """Calls needed per group when texts go out in order, ``batch_size`` at a time."""
    return (
        numbered.select(
            *group, number.alias("_n"), F.floor(number / batch_size).alias("batch_no")
        )
        .groupBy(*group, "batch_no")
        .agg(
            F.count(F.lit(1)).alias("texts"),
            F.min("_n").alias("first_text"),
            F.max("_n").alias("last_text"),
        )
    )


def validate_embeddings(records: DataFrame, group: str, dimension: int) -> DataFrame:
    """Per group: records, missing vectors, vectors of another length or with a number that is none."""
    size = F.size("embedding")
    whole = finite(F.col("embedding"))
    return records.groupBy(group).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("embedding").isNull()).alias("missing"),
        F.count_if(F.col("embedding").isNotNull() & (size != dimension)).alias("wrong_size"),
        F.count_if(F.col("embedding").isNotNull() & (size == dimension) & ~whole).alias("not_finite"),
        F.count_if(F.col("embedding").isNotNull() & (size == dimension) & whole).alias("valid"),
    )


def require_valid(records: DataFrame, dimension: int | Column | None) -> DataFrame:
    """Pass records through and fail the job at the first bad vector; NULL ``dimension`` allows any length."""
    wanted = F.lit(dimension).cast("int") if not isinstance(dimension, Column) else dimension
    good = (
        F.col("embedding").isNotNull() & finite(F.col("embedding"))
        & (F.size("embedding") == F.coalesce(wanted, F.size("embedding")))
    )
    checked = F.when(good, F.col("embedding")).otherwise(F.raise_error(F.concat(
        F.lit("expected a vector of "), F.coalesce(wanted.cast("string"), F.lit("any number of")),
        F.lit(" numbers"))))
    return records.withColumn("embedding", checked)


def attach_embeddings(records: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Pair records with precomputed vectors by key; one without a vector stays, with ``error`` set."""
    missing = F.when(F.col("embedding").isNull(), "missing_vector")
    return records.join(vectors.select(*keys, "embedding"), keys, "left").withColumn("error", missing)
