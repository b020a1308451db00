"""Collections of vectors as Parquet, listed in a manifest.

Every write makes a folder of its own below ``data``, with a folder per collection. What counts is in the manifest:
a row per collection and write, with the number of records, the lengths of the vectors and the provider that made them.
A new version of the manifest is committed by renaming one folder, so that readers see all of a change or nothing;
a write that fails leaves the version before it. A collection is read from the folders that its rows name: the
store as a whole is never listed for it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.schemas import COLLECTION, MANIFEST
from docquarry.session import delete_path, list_names, rename_new, spread, stage

NAMED = 1_000
KEPT_VERSIONS = 2
PROVIDER = [name for name in MANIFEST.names if name.startswith("provider")]


class CollectionStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.data, self.versions = f"{self.root}/data", f"{self.root}/manifest"

    def _version(self) -> int:
        """Number of the newest manifest, 0 if there is none."""
        return max((int(name[1:]) for name in list_names(self.spark, self.versions) if name.startswith("v")), default=0)

    def manifest(self) -> DataFrame:
        """``(collection_name, write, of, records, shortest, longest, provider_name, provider_model, provider_batch_size)``.

        A collection has a row per write that it still uses. A collection without records has one without ``write``; ``of``
        tells how many collections the write made.
        """
        version = self._version()
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.versions}/v{version}")

    def _commit(self, manifest: DataFrame, after: int) -> None:
        """Make ``manifest`` the version that follows ``after``; fails if another writer was faster."""
        made = f"{self.versions}/new-{uuid.uuid4().hex}"
        manifest.select(MANIFEST.names).write.parquet(made)
        rename_new(self.spark, made, f"{self.versions}/v{after + 1}")
        for old in range(after + 1 - KEPT_VERSIONS, 0, -1):
            if not delete_path(self.spark, f"{self.versions}/v{old}"):
                break

    def _replaced(self, now: DataFrame, rows: DataFrame) -> DataFrame:
        """A manifest in which ``rows`` stand for all rows of their collections."""
        names = rows.select(F.col("collection_name").alias("_name")).distinct()
        return now.join(names, F.col("collection_name") == F.col("_name"), "left_anti").unionByName(rows)

    def _empty_rows(self, names: DataFrame, now: DataFrame) -> DataFrame:
        """Rows of collections without records; they keep their provider."""
        rows = names.select("collection_name").join(_providers(now), "collection_name", "left")
        values = {"records": F.lit(0)}
        return rows.select(*[
            (F.col(c) if c in rows.columns else values.get(c, F.lit(None))).cast(MANIFEST[c].dataType).alias(c)
            for c in MANIFEST.names])

    def scan(self, *names: str) -> DataFrame:
        """All records, or those of the named collections (only their folders are listed and read)."""
        live = self.manifest().where("write is not null")
        reader = self.spark.read.schema(COLLECTION).option("basePath", self.data)
        if names:
            rows = live.where(F.col("collection_name").isin(list(names))).select("collection_name", "write").collect()
            if not rows:
                return self.spark.createDataFrame([], COLLECTION)
            paths = [f"{self.data}/write={r['write']}/collection_name={_folder(r['collection_name'])}" for r in rows]
            return spread(reader.parquet(*paths).select(COLLECTION.names).where(F.col("collection_name").isin(list(names))))
        writes = live.groupBy("write").agg(F.count("*").alias("used"), F.first("of").alias("of")).collect()
        if not writes:
            return self.spark.createDataFrame([], COLLECTION)
        records = reader.parquet(*[f"{self.data}/write={r['write']}" for r in writes])
        if any(r["used"] != r["of"] for r in writes):  # some folders were replaced by later writes
            records = records.join(live.select("write", "collection_name"), ["write", "collection_name"], "left_semi")
        return spread(records.select(COLLECTION.names))

    def scan_for(self, names: DataFrame) -> DataFrame:
        """Records of the collections in ``names(collection_name)``."""
        some = names.select("collection_name").distinct()
        few = [r["collection_name"] for r in some.limit(NAMED + 1).collect()]
        if len(few) <= NAMED:
            return self.scan(*few) if few else self.spark.createDataFrame([], COLLECTION)
        return self.scan().join(some, "collection_name", "left_semi").select(COLLECTION.names)

    def exists(self, name: str) -> bool:
        return not self.manifest().where(F.col("collection_name") == name).isEmpty()

    def open(self, name: str) -> DataFrame:
        """Records of a collection; a missing one is created empty."""
        version, now = self._version(), self.manifest()
        if now.where(F.col("collection_name") == name).isEmpty():
            self._commit(now.unionByName(self._empty_rows(self._named(name), now)), version)
        return self.scan(name)

    def write(self, records: DataFrame, providers: DataFrame | None = None) -> None:
        """Replace every collection that occurs in ``records``; others stay as they are.

        ``providers(collection_name, provider_name, provider_model, provider_batch_size)`` is kept with the collections.
        """
        version, now = self._version(), self.manifest()
        self._commit(self._replaced(now, self._saved(records, providers)), version)

    def add(self, records: DataFrame) -> None:
        """Insert records whose id its collection does not hold yet; of repeats that with the least hash is inserted.

        Only ids of the collections in ``records`` are read.
        """
        version, now = self._version(), self.manifest()
        content = F.xxhash64(*[c for c in COLLECTION.names if c != "metadata"], F.to_json("metadata"))
        first = records.groupBy("collection_name", "id").agg(F.min(content).alias("_first"))
        once = records.withColumn("_first", content).join(first, ["collection_name", "id", "_first"], "left_semi").dropDuplicates(
            ["collection_name", "id"])
        new = self._saved(absent(once, self.scan_for(records)), _providers(now))
        self._commit(now.unionByName(new), version)

    def delete(self, ids: DataFrame) -> None:
        """Remove the records ``ids(collection_name, id)``; only collections that lose some are rewritten."""
        version, now = self._version(), self.manifest()
        named = stage(ids.select("collection_name", "id").distinct(), "deleted")
        stored = self.scan_for(named)
        hit = stage(
            stored.select("collection_name", "id").join(named, ["collection_name", "id"], "left_semi")
            .select("collection_name").distinct(), "hit",
        )
        kept = without(stored.join(hit, "collection_name", "left_semi"), named)
        rows = self._saved(kept, _providers(now))
        emptied = hit.join(rows.select("collection_name"), "collection_name", "left_anti")
        self._commit(self._replaced(now, rows.unionByName(self._empty_rows(emptied, now))), version)

    def clear(self, name: str) -> None:
        """Remove all records of a collection and leave it empty."""
        version, now = self._version(), self.manifest()
        self._commit(self._replaced(now, self._empty_rows(self._named(name), now)), version)

    def counts(self) -> DataFrame:
        """``(collection_name, record_count)`` of collections with records, from the manifest."""
        return self.contracts().where("record_count > 0").select("collection_name", "record_count")

    def first(self) -> DataFrame:
        """The collection to use when none is named: the smallest name."""
        return first_collection(self.counts())

    def contracts(self) -> DataFrame:
        """``(collection_name, record_count, shortest, longest, provider_name, provider_model, provider_batch_size)``, from the manifest."""
        return self.manifest().groupBy("collection_name").agg(
            F.sum("records").alias("record_count"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest"),
            *[F.first(c, True).alias(c) for c in PROVIDER])

    def info(self, projects: DataFrame) -> DataFrame:
        """Name, address, size and vector length of each project's collection, from the manifest."""
        return _info(projects, self.contracts().where("record_count > 0").select(
            "collection_name", "record_count", F.col("longest").alias("dimension")))

    def vacuum(self) -> int:
        """Remove the folders of writes that no collection uses any more; how many there were."""
        used = {r["write"] for r in self.manifest().where("write is not null").select("write").distinct().collect()}
        gone = [name for name in list_names(self.spark, self.data) if name.startswith("write=") and name[6:] not in used]
        for name in gone:
            delete_path(self.spark, f"{self.data}/{name}")
        return len(gone)

    def _named(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([(name,)], "collection_name string")

    def _saved(self, records: DataFrame, providers: DataFrame | None) -> DataFrame:
        """Write records to a folder of their own; the manifest rows of its collections."""
        write = uuid.uuid4().hex
        path = f"{self.data}/write={write}"
        # Rebalancing gives files of even size and splits a large collection over tasks.
        records.select(COLLECTION.names).hint("rebalance", "collection_name").write.partitionBy("collection_name").parquet(path)
        size = F.size("embedding")
        sizes = stage(self.spark.read.schema(COLLECTION).parquet(path).groupBy("collection_name").agg(
            F.count(F.lit(1)).alias("records"), F.min(size).alias("shortest"), F.max(size).alias("longest")), "sizes")
        made = sizes.count()
        if providers is not None:
            sizes = sizes.join(providers, "collection_name", "left")
        values = {"write": F.lit(write), "of": F.lit(made)}
        return sizes.select(*[
            (values[c] if c in values else F.col(c) if c in sizes.columns else F.lit(None)).cast(MANIFEST[c].dataType).alias(c)
            for c in MANIFEST.names])


def _providers(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("collection_name").agg(*[F.first(c, True).alias(c) for c in PROVIDER])


def _folder(name: str) -> str:
    """The value of a partition folder as Spark writes it."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "\"#%'*/:=?\\{[]^\x7f" else c for c in name)


def absent(records: DataFrame, existing: DataFrame) -> DataFrame:
    keys = ["collection_name", "id"]
    return records.join(existing.select(*keys), keys, "left_anti")


def without(records: DataFrame, ids: DataFrame) -> DataFrame:
    keys = ["collection_name", "id"]
    return records.join(ids.select(*keys), keys, "left_anti")


def counts(records: DataFrame) -> DataFrame:
    return records.groupBy("collection_name").agg(F.count(F.lit(1)).alias("record_count"))


def first_collection(records: DataFrame) -> DataFrame:
    return records.agg(F.min("collection_name").alias("collection_name"))


def info(projects: DataFrame, records: DataFrame) -> DataFrame:
    """Name, address, size and vector length of each project's collection."""
    return _info(projects, records.groupBy("collection_name").agg(
        F.count(F.lit(1)).alias("record_count"), F.max(F.size("embedding")).alias("dimension")))


def _info(projects: DataFrame, sizes: DataFrame) -> DataFrame:
    return projects.join(sizes, "collection_name", "left").select(
        F.col("name"), "collection_name", F.col("url"),
        F.coalesce("record_count", F.lit(0).cast("bigint")).alias("record_count"), "dimension",
    )
