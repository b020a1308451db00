"""Session settings and the shared folder used to cut long plans."""

from __future__ import annotations

import gc
import math
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}


def local_session(cpus: int | str = 8, app: str = "docquarry") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a folder
    that exists on one machine would be lost with that machine.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="docquarry-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/docquarry/{uuid.uuid4().hex}/{name}"


_scopes: list[list[Callable[[], object]]] = []


def _at_end(undo: Callable[[], object], keep: bool) -> None:
    owner = len(_scopes) - (2 if keep else 1)
    if owner >= 0:
        _scopes[owner].append(undo)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end, but for those staged with ``keep``.

    What leaves a scope must not read any other: stage it with ``keep``, which leaves it to
    the scope around, if there is one.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for undo in _scopes.pop():
            undo()


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of it.

    Unlike a checkpointed RDD the result keeps column pruning, filter pushdown and a
    size estimate, and it survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _at_end(lambda: delete_path(spark, path.rsplit("/", 1)[0]), keep)
    return spark.read.schema(df.schema).parquet(path)


def stage_in_turn(frames: Iterable[DataFrame], name: str) -> DataFrame:
    """``stage`` for the rows of several frames, at least one; what one has shuffled is removed before the next is made."""
    path, schema = "", None
    for df in frames:
        if schema is None:
            spark, schema, path = df.sparkSession, df.schema, scratch_path(df.sparkSession, name)
            _at_end(lambda: delete_path(spark, path.rsplit("/", 1)[0]), False)
        df.write.mode("append").parquet(path)
        del df
        release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of frames that are gone.

    Its cleaner learns of them when the driver happens to collect its garbage, which may be long after a disk is full. The
    first collection frees what the last query leaves behind, the second its shuffles.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.1)


class KeyedTable:
    """A table in the shared folder, hashed by ``keys`` into as many buckets as a shuffle has partitions.

    A join or aggregation on ``keys`` shuffles the other side only, however often the table is used. It
    may grow by appends; a scan shows what it held when the scan was made.
    """

    def __init__(self, spark: SparkSession, name: str, *keys: str):
        self.spark, self.keys = spark, keys
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"docquarry_{uuid.uuid4().hex}"
        self.path = scratch_path(spark, name)
        _at_end(self.drop, False)

    def append(self, df: DataFrame, placed: bool = False) -> DataFrame:
        """Add rows, and scan the whole table. ``placed`` rows lie where ``place`` puts them."""
        (df if placed else self.place(df)).write.format("parquet").mode("append").option("path", self.path).bucketBy(
            self.parts, *self.keys).saveAsTable(self.table)
        return self.scan()

    def place(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.parts, *self.keys)

    def scan(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.table}")
        delete_path(self.spark, self.path.rsplit("/", 1)[0])


def stage_keyed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """``stage`` as a ``KeyedTable``."""
    return KeyedTable(df.sparkSession, name, *keys).append(df)


BITS_PER_KEY = 16
MOST_WORDS = 1 << 20


def _with_bits(df: DataFrame, columns: list[Column], keys: DataFrame, key_columns: list[Column], how: str) -> tuple[DataFrame, Column]:
    """``df`` with a bitmap of ``keys`` joined, and whether a row's bit is set."""
    def word(place: Column) -> Column:
        return F.pmod(place, F.lit(words)).cast("int")

    def bit(place: Column) -> Column:
        return F.shiftrightunsigned(place, 58).cast("int")

    # Longer than any column of ``df``, so that none is hidden.
    own = [f"{'_' * max(map(len, df.columns))}_{name}" for name in ("word", "bit", "bits")]
    n = max(keys.count(), 1)
    words = min(MOST_WORDS, 1 << max(0, math.ceil(math.log2(n * BITS_PER_KEY / 64))))
    place, key = F.xxhash64(*columns), F.xxhash64(*key_columns)
    bits = keys.groupBy(word(key).alias(own[0])).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(key))).alias(own[2]))
    found = df.withColumns({own[0]: word(place), own[1]: bit(place)}).join(F.broadcast(bits), own[0], how)
    return found, F.call_function("shiftright", F.col(own[2]), F.col(own[1])).bitwiseAND(F.lit(1)) == 1


def maybe_in(df: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``columns`` may be those of a row of ``keys``; all that are, and few others.

    Ahead of an exact join it keeps rows with large columns out of the shuffle. What is broadcast is a
    table of ``MOST_WORDS`` words of 64 bits at most; with more keys than that has room for, more
    rows pass. Rows with a null among ``columns`` are dropped.
    """
    names = [F.col(c) for c in columns]
    found, held = _with_bits(df.where(" and ".join(f"`{c}` is not null" for c in columns)), names, keys, names, "inner")
    return found.where(held).select(df.columns)


def split_by(df: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``column``, an integer, may be in ``keys(column)``, and rows where it surely is not, null among them.

    Both are scans of ``df`` beside a broadcast bounded as that of ``maybe_in``; nothing of ``df`` is shuffled.
    """
    name = F.col(column).cast("bigint")
    found, held = _with_bits(df, [name], keys.where(F.col(column).isNotNull()), [name], "left")
    held = F.coalesce(held & F.col(column).isNotNull(), F.lit(False))
    return found.where(held).select(df.columns), found.where(~held).select(df.columns)


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan with fewer partitions than cores, ahead of costly work per row.

    A large scan has more partitions than that and is left as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


SALTS = 16


def salt_of(column: str) -> Column:
    """One of ``SALTS`` parts of a key, chosen by ``column``; joins with ``all_salts``."""
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def all_salts() -> Column:
    """``_salt``: a row per part, for the small side of a join whose other side has hot keys."""
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _filesystem(spark, path)
    return fs.exists(hadoop_path)


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _filesystem(spark, path)
    return fs.delete(hadoop_path, True)


def make_dir(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _filesystem(spark, path)
    fs.mkdirs(hadoop_path)


def _filesystem(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, hadoop_path = _filesystem(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(hadoop_path)] if fs.exists(hadoop_path) else []


def rename_new(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; fails if there is something at ``target`` already."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    none[0] = hadoop.Options.Rename.NONE
    old, new = hadoop.Path(source), hadoop.Path(target)
    hadoop.FileContext.getFileContext(old.toUri(), spark._jsc.hadoopConfiguration()).rename(old, new, none)
