"""Approximate nearest neighbours: records in cells around centroids, and a search that reads the nearest cells only.

Centroids are fitted by k-means on a sample of bounded size; every record is then put in the cell of its nearest
centroid. The cell is a partition column of the stored index, so that a search reads the folders of the cells that
its queries probe. Within them it is exact: with all cells probed the result is that of ``knn_batch``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.vectors import finite
from docquarry.operators.knn import TOP_K, knn_batch

CELLS = 256
MOST_CELLS = 4_096
PROBES = 16
SAMPLE_ROWS = 100_000
ROUNDS = 10
_KEY = "concat(cell, ':', collection_name)"


def write_cells(records: DataFrame, path: str, cells: int = CELLS, metric: str = "l2",
                sample_rows: int = SAMPLE_ROWS, seed: int = 0) -> None:
    """Index all ``records(collection_name, id, embedding)`` whose vectors have one common length.

    A vector with a number that is NULL, NaN or infinite is left out, as in a search. Vectors of several lengths
    are refused. At most ``sample_rows`` records, chosen by a hash, fit at most ``cells`` centroids.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError("cells are made for the metrics l2 and cosine")
    if not 0 < cells <= MOST_CELLS:
        raise ValueError(f"from 1 to {MOST_CELLS} cells")
    spark = records.sparkSession
    good = records.select("collection_name", "id", F.col("embedding").cast("array<float>").alias("embedding")).where(
        (F.size("embedding") > 0) & finite(F.col("embedding")))
    shape = good.agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"),
                     F.count("*").alias("rows")).first()
    if shape["least"] != shape["most"]:
        raise ValueError(f"vectors of {shape['least']} to {shape['most']} numbers")
    centroids = _fit(good, shape["rows"], cells, metric, sample_rows, seed) if shape["rows"] else []
    spark.createDataFrame(
        [(i, [float(x) for x in c], metric) for i, c in enumerate(centroids)],
        "cell int, centroid array<double>, metric string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    schema = T.StructType([*good.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    placed = good.mapInArrow(_nearest_cells(centroids, metric, 1, "embedding"), schema)
    # A large cell is split over tasks, small ones share files.
    placed.select("collection_name", "id", "embedding", F.col("cells")[0].alias("cell")).hint("rebalance", "cell").write.mode(
        "overwrite").partitionBy("cell").parquet(f"{path}/records")


def _fit(good: DataFrame, rows: int, cells: int, metric: str, sample_rows: int, seed: int) -> list:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = min(1.0, sample_rows / rows)
    chosen = good.where(F.pmod(F.xxhash64("collection_name", "id", F.lit(seed)), F.lit(1 << 30)) < math.ceil(share * (1 << 30)))
    vectors = _unit(chosen) if metric == "cosine" else chosen.select(F.col("embedding").cast("array<double>").alias("v"))
    model = KMeans(k=cells, maxIter=ROUNDS, seed=seed, featuresCol="f").fit(vectors.select(array_to_vector("v").alias("f")))
    return model.clusterCenters()


def _unit(df: DataFrame) -> DataFrame:
    squares = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("_n", F.sqrt(squares)).select(
        F.transform("embedding", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(F.lit(0.0))).alias("v"))


def _nearest_cells(centroids: list, metric: str, probes: int, column: str):
    """Task-side: adds ``cells``, the numbers of the ``probes`` centroids nearest to a vector, nearest first."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        if not centroids:
            return
        middle = np.array(centroids, "float64")
        own = (middle * middle).sum(axis=1)
        count = min(probes, len(middle))
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype("float64")
            x = flat.reshape(batch.num_rows, -1)
            if metric == "cosine":
                norm = np.sqrt((x * x).sum(axis=1))[:, None]
                x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
            order = np.argsort(own[None, :] - 2.0 * (x @ middle.T), axis=1, kind="stable")[:, :count]
            yield batch.append_column("cells", pa.array(order.astype("int32").tolist(), pa.list_(pa.int32())))

    return run


def search_cells(queries: DataFrame, path: str, probes: int = PROBES) -> DataFrame:
    """``(query_id, rank, collection_name, id, distance)`` of the best records in the ``probes`` cells nearest to each query.

    ``queries(query_id, collection_name, vector, top_k)`` as for ``knn_batch``; a query whose vector has another length
    than the index, or a number that is none, finds nothing.
    """
    spark = queries.sparkSession
    found = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    stored = scan_cells(spark, path)
    length, metric = (len(found[0]["centroid"]), found[0]["metric"]) if found else (0, "l2")
    asked = queries.select(
        "query_id", "collection_name", F.col("vector").cast("array<double>").alias("vector"),
        F.coalesce("top_k", F.lit(TOP_K)).alias("top_k"),
    ).where((F.size("vector") > 0) & (F.size("vector") == length) & finite(F.col("vector")))
    schema = T.StructType([*asked.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    probed = asked.mapInArrow(_nearest_cells([r["centroid"] for r in found], metric, probes, "vector"), schema).select(
        "query_id", "vector", "top_k", "collection_name", F.explode("cells").alias("cell"))
    wanted = [r["cell"] for r in probed.select("cell").distinct().collect()]
    near = stored.where(F.col("cell").isin(wanted)).withColumn("collection_name", F.expr(_KEY))
    nearest = knn_batch(probed.withColumn("collection_name", F.expr(_KEY)), near, metric)
    return nearest.withColumn("collection_name", F.regexp_extract("collection_name", r"(?s)^\d+:(.*)$", 1))


def scan_cells(spark: SparkSession, path: str) -> DataFrame:
    """``(collection_name, id, embedding, cell)`` of all records of an index."""
    schema = "collection_name string, id string, embedding array<float>, cell int"
    return spark.read.schema(schema).parquet(f"{path}/records")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``queries`` and the mean share of their exact answers that were found, as ``recall``."""
    keys = ["query_id", "collection_name", "id"]
    hits = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("_hit")), keys, "left")
    each = hits.groupBy("query_id").agg((F.count("_hit") / F.count("*")).alias("_share"))
    return each.agg(F.count("*").alias("queries"), F.avg("_share").alias("recall"))
