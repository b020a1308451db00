"""Exact top-k search by an impact-ordered index, one score at a time.

Vectors are cut into shards of bounded size. A shard's index has posting segments: for every
dimension, the vectors whose component has one quantised level. For a query a segment's impact is
its level times the query's component, counted from the least impact of the dimension, so that no
impact is negative. Segments are processed by descending impact into accumulators, those of a round
at once. What a vector may still gain is bounded by the next impact times the dimensions it has not
met. Processing stops once that proves that all possible members are few, or none, and those are
scored exactly.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import batch_of, rows_in
from docquarry.session import stage

SCALE = 64
SHARD = 4096
QUERY_BLOCK = 512
SALTS = 4
LEVELS = 24
ROUNDS = (0.85, 1.0)
_MET = 1 << 48
FEW = 96


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


class Shard:
    """Posting segments of the vectors ``values`` (a row each) with ``ids``."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        n, dims = values.shape
        least, most = values.min(axis=0), values.max(axis=0)
        step = np.maximum(1, -(-(most - least + 1) // LEVELS))
        level = (values - least) // step + np.arange(dims) * (LEVELS + 1)
        used, segment = np.unique(level, return_inverse=True)
        #: Segment of every vector in every dimension, a row per dimension.
        self.segment = np.ascontiguousarray(segment.reshape(n, dims).T)
        self.owner = used // (LEVELS + 1)
        self.lows = least[self.owner] + used % (LEVELS + 1) * step[self.owner]
        self.highs = np.minimum(self.lows + step[self.owner] - 1, most[self.owner])
        self.sizes = np.bincount(segment.reshape(-1), minlength=len(used))

    @staticmethod
    def load(data: bytes) -> "Shard":
        arrays = np.load(io.BytesIO(data))
        return Shard(arrays["ids"], arrays["values"])

    def search(self, own: int, query: np.ndarray, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """``best`` as (-score, id), sorted, with what this shard adds to it."""
        dims = self.values.shape[1]
        weight = query[self.owner]
        most = np.maximum(weight * self.lows, weight * self.highs)
        base = np.full(dims, np.iinfo(np.int64).max)
        np.minimum.at(base, self.owner, np.minimum(weight * self.lows, weight * self.highs))
        impact = most - base[self.owner]
        ranked = np.argsort(-impact, kind="stable")
        places = np.cumsum(self.sizes[ranked])
        offset = int(base.sum())
        together = dims < 1 << 14 and int(impact.max()) * dims < _MET
        for share in ROUNDS:
            done = int(np.searchsorted(places, share * places[-1])) + 1
            taken = np.zeros(len(impact), dtype=np.int64)
            taken[ranked[:done]] = 1
            if together:
                total = np.take(taken * (impact + _MET), self.segment).sum(axis=0)
                met, gained = total >> 48, total & (_MET - 1)
            else:
                met = np.take(taken, self.segment).sum(axis=0)
                gained = np.take(taken * impact, self.segment).sum(axis=0)
            following = impact[ranked[done]] if done < len(ranked) else 0
            ceiling = gained + (dims - met) * following + offset
            possible = self._possible(ceiling, best, k)
            if len(possible) <= FEW:
                break
        while len(possible):
            part = possible[:FEW]
            scores = self.values[part] @ query
            best = best + [(-int(s), int(i)) for s, i in zip(scores, self.ids[part]) if i != own]
            best = sorted(best)[:k]
            possible = possible[FEW:]
            if len(best) == k:
                possible = possible[ceiling[possible] >= -best[-1][0]]
        return best

    @staticmethod
    def _possible(ceiling: np.ndarray, best: list[tuple[int, int]], k: int) -> np.ndarray:
        possible = np.flatnonzero(ceiling >= -best[-1][0]) if len(best) == k else np.arange(len(ceiling))
        return possible[np.argsort(-ceiling[possible], kind="stable")]


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id, dims, q``: whole numbers, without null, empty or non-finite vectors and null ids."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & good).select(
        "vec_id", F.size("embedding").alias("dims"), F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("q"))


def _pack(group: pa.Table) -> pa.Table:
    ids = group.column("vec_id").to_numpy()
    values = group.column("q").combine_chunks().values.to_numpy().reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return pa.table({"dims": group.column("dims")[:1], "part": group.column("part")[:1],
                     "data": pa.array([_packed(ids=ids[order], values=values[order])], pa.binary())})


def _parts(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Rows packed into parts of about ``size``, and the number of parts."""
    count = 1 + rows.count() // size
    part = F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    packed = rows.withColumn("part", part).groupBy("dims", "part").applyInArrow(_pack, "dims int, part int, data binary")
    return stage(packed, "parts"), count


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, ids, queries = None, {}, None, None

        def flush() -> pa.RecordBatch:
            found = [(query, i, -s) for query, members in best.items() for s, i in members]
            return batch_of(schema, *(zip(*found) if found else ([], [], [])))

        for *key, asked, data in rows_in(batches, "dims", "block", "asked", "data"):
            if key != block:
                if best:
                    yield flush()
                arrays = np.load(io.BytesIO(asked))
                block, ids, queries, best = key, arrays["ids"], arrays["values"], {}
            shard = Shard.load(data)
            for number, (own, query) in enumerate(zip(ids.tolist(), queries)):
                best[own] = shard.search(own, query, best.get(own, []), k)
        if best:
            yield flush()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of ``vectors(vec_id, embedding)`` per query of the same form.

    Components are floored after scaling, the score is the whole-number inner product, ties go to the
    smaller ``vec_id``. Rows with the query's own ``vec_id`` are no candidates. Vectors that are null or empty, or hold
    a null or non-finite component, and null ids take no part; vectors of different length do not meet. A ``vec_id`` that
    asks twice is one query with either's vector; other columns are ignored; an empty table on either side gives no rows.

    Queries and vectors are cut into parts of bounded size; every part of queries meets every shard, in
    as many tasks as there are parts times ``SALTS``.
    """
    shards, _ = _parts(quantised(vectors), SHARD)
    asked, blocks = _parts(quantised(queries).dropDuplicates(["vec_id"]), QUERY_BLOCK)
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    left = shards.select("dims", "data", (F.col("part") % SALTS).alias("salt"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.select("dims", F.col("part").alias("block"), F.col("data").alias("asked"), salt.alias("salt"))
    cells = left.join(right, ["dims", "block", "salt"]).sortWithinPartitions("dims", "block")
    found = cells.select("dims", "block", "asked", "data").mapInArrow(
        _search(k), "query_id bigint, vec_id bigint, score bigint")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
