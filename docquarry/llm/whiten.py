"""Embedding whitening by spectral divide and conquer on QDWH polar decompositions.

Three passes of the vectors: exact sums of their quantised entries, the covariance about the mean, and the
projections. What reaches the driver is one d x d matrix, whatever the number of vectors; d is at most
``MOST_DIMENSIONS``. There its principal components are found: the polar factor of the shifted matrix is +1
on the eigenvectors above the shift and -1 on those below, so it gives the projector that splits the space in two
invariant ones, which are split again until they have one dimension or one eigenvalue.
The projection to the first components goes to every task as a broadcast matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.vectors import finite
from docquarry.llm.common import batch_of
from docquarry.session import scope, stage

COMPONENTS = 8
SCALE, OFFSET = 1024.0, 100_000
MOST_DIMENSIONS = 4_096
#: Entries up to this size are whole numbers of a double after scaling.
MOST = float(1 << 40)
EPS = float(np.finfo(np.float64).eps)


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley iterations."""
    size = len(a)
    x = a / np.linalg.norm(a)
    low, eye = EPS, np.eye(size)
    for _ in range(40):
        d = np.cbrt(4.0 * (1.0 - low * low) / low ** 4)
        r = np.sqrt(1.0 + d)
        wa = r + 0.5 * np.sqrt(8.0 - 4.0 * d + 8.0 * (2.0 - low * low) / (low * low * r))
        wb = (wa - 1.0) ** 2 / 4.0
        wc = wa + wb - 1.0
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        then = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * q[:size] @ q[size:].T
        then = (then + then.T) / 2.0
        low = min(low * (wa + wb * low * low) / (1.0 + wc * low * low), 1.0 - EPS)
        moved, x = np.linalg.norm(then - x), then
        if moved < EPS ** (1 / 3) and 1.0 - low < 1e-12:
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant spaces above and below a shift; None if no shift parts the eigenvalues."""
    size, diagonal = len(a), np.sort(np.diag(a))
    mean = diagonal.mean()
    spread = np.linalg.norm(a - mean * np.eye(size)) / np.sqrt(size)
    middle = (diagonal[(size - 1) // 2] + diagonal[size // 2]) / 2.0
    best = None
    for shift in (middle, mean, mean + spread / 7, mean - spread / 7, mean + spread / 3, mean - spread / 3):
        sign = polar_factor(a - shift * np.eye(size))
        projector = (sign + np.eye(size)) / 2.0
        rank = round(float(np.trace(projector)))
        if not 0 < rank < size:
            continue
        start = np.random.default_rng(size).standard_normal((size, rank))
        basis, _ = np.linalg.qr(projector @ start)
        whole, _ = np.linalg.qr(projector @ basis, mode="complete")
        above, below = whole[:, :rank], whole[:, rank:]
        left = np.linalg.norm(below.T @ a @ above)
        if best is None or left < best[0]:
            best = left, above, below
        if left <= 10 * EPS * size * scale:
            break
    return best[1:] if best else None


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix."""
    scale = float(np.linalg.norm(a))
    found: list[tuple[float, np.ndarray]] = []
    todo = [np.eye(len(a))]
    while todo:
        basis = todo.pop()
        inner = basis.T @ a @ basis
        inner = (inner + inner.T) / 2.0
        size = len(inner)
        flat = np.linalg.norm(inner - np.trace(inner) / size * np.eye(size)) <= EPS * size * scale
        parts = None if size == 1 or flat else _split(inner, scale)
        if parts is None:
            found += [(float(inner[i, i]), basis[:, i]) for i in range(size)]
        else:
            todo += [basis @ part for part in parts]
    found.sort(key=lambda pair: -pair[0])
    vectors = np.column_stack([v for _, v in found])
    vectors /= np.linalg.norm(vectors, axis=0)
    return np.array([v @ a @ v for v in vectors.T]), vectors


def quantised(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """``floor(1024 * c) + 100000`` of every entry as whole doubles, a row per vector."""
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat.reshape(-1, size)) + OFFSET


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per vector and component, from 1.

    ``vectors(vec_id, embedding)``. A vector that is null or empty, or holds a null, a number that is not finite or
    one beyond ``MOST``, takes no part; nor does one of another length than most have (the shorter on a tie). All
    others, repeated rows and null ids included, are the fit list and get rows. With fewer dimensions than
    ``components`` there are fewer rows. A component without variance has null in ``whitened``, and
    ``explained`` is null where nothing varies. ``deviation`` is null where it is beyond a long. Other columns are
    ignored; an empty table gives no rows.
    """
    with scope(vectors.sparkSession):
        return stage(_whiten(vectors, components), "whitened", keep=True)


def _whiten(vectors: DataFrame, components: int) -> DataFrame:
    spark = vectors.sparkSession
    good = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        (F.size("embedding") > 0) & finite(F.col("embedding"))
        & F.forall("embedding", lambda c: F.abs(c) <= MOST))
    lengths = good.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    schema = "vec_id {0}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema.format(dict(good.dtypes)["vec_id"]))
    size, n = lengths["size"], lengths["count"]
    if size > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {size} dimensions; at most {MOST_DIMENSIONS} are taken")
    fit = good.where(F.size("embedding") == size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = quantised(batch, size).astype(np.int64).sum(axis=0)
            yield batch_of(pa.schema([("j", pa.int32()), ("v", pa.int64())]), np.arange(size, dtype=np.int32), total)

    added = fit.mapInArrow(sums, "j int, v bigint").groupBy("j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    total = [int(r["v"]) for r in sorted(added.collect())]
    mean = np.array([(s // n) + (s % n) / n for s in total])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, seen = np.zeros((size, size)), False
        for batch in batches:
            z = quantised(batch, size) - mean
            matrix += z.T @ z
            seen = True
        if seen:
            out = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])
            yield batch_of(out, np.arange(size, dtype=np.int32), matrix.tolist())

    rows = fit.mapInArrow(products, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    cells = rows.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    covariance = np.zeros((size, size))
    covariance[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy() / n
    values, axes = eigen((covariance + covariance.T) / 2.0)
    count = min(components, size)
    values, axes, trace = values[:count], axes[:, :count], float(np.trace(covariance))
    live = values > size * EPS * max(trace, 0.0)
    shared = spark.sparkContext.broadcast(axes[:, live] / np.sqrt(values[live]))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = [int(s) for s in total]
        small = max(map(abs, wide)) < 1 << 61
        exact = np.array(wide, dtype=np.int64 if small else object)
        out = pa.schema([("vec_id", batch_type), ("deviation", pa.int64()), ("w", pa.list_(pa.float64()))])
        for batch in batches:
            x = quantised(batch, size)
            z = x - mean
            most = float(np.abs(z).max(initial=0.0)) * n
            if small and most < 2 ** 31 and size * most * most < 2 ** 61 and np.abs(x).max(initial=0.0) * n < 2 ** 61:
                gap = n * x.astype(np.int64) - exact
                deviation = (gap * gap).sum(axis=1).tolist()
            else:
                gap = n * x.astype(np.int64).astype(object) - exact.astype(object)
                deviation = [d if d < 1 << 63 else None for d in (int(d) for d in (gap * gap).sum(axis=1))]
            yield batch_of(out, batch.column("vec_id"), deviation, (z @ shared.value).tolist())

    id_type = dict(fit.dtypes)["vec_id"]
    batch_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    done = stage(fit.mapInArrow(project, f"vec_id {id_type}, deviation bigint, w array<double>"), "projected")
    error = _identity_error(done, int(live.sum()))
    place = np.cumsum(live) - 1
    described = F.array(*[F.struct(
        F.lit(i + 1).alias("component"),
        (F.col("w")[int(place[i])] if live[i] else F.lit(None).cast("double")).alias("whitened"),
        F.lit(float(values[i] / trace) if trace > 0 else None).cast("double").alias("explained")) for i in range(count)])
    return done.select("vec_id", "deviation", F.explode(described).alias("c")).select(
        "vec_id", "c.component", F.lit(n).cast("bigint").alias("n"), "deviation", "c.whitened", "c.explained",
        F.lit(error).cast("double").alias("identity_error"))


def _identity_error(done: DataFrame, count: int) -> float | None:
    """Largest absolute entry of the covariance of ``w`` minus the identity, measured on the rows."""
    if not count:
        return None
    w = [F.col("w")[i] for i in range(count)]
    means = done.agg(*[F.avg(x) for x in w]).first()
    off = [x - F.lit(m) for x, m in zip(w, means)]
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    found = done.agg(*[F.avg(off[i] * off[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))
