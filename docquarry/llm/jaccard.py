"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of word shingles, as 64-bit hashes. All sets are sorted by one order,
rarest first. Two similar sets have at least ``o`` elements in common, and of these at least ``l``
lie among the first ``n - o + l`` of either, for any ``l``. Each document chooses its own ``l`` by the
estimated cost of its candidates: a longer prefix asks more of a partner. A pair is a candidate
if it shares the smaller of both documents' ``l`` (more for large sets) within the prefixes of that length, and is
verified if it then shares as much as the whole prefixes of both must. Pairs whose signatures, the parities of
the sets' elements by bucket, differ in more places than similar sets have elements apart are never made.

Equal sets are one set. Groups of similar sets are first linked to a few pivots, so that
a group of any size costs rows in proportion to its size; then every pair of sets that are
not yet in one component and that the prefixes admit is verified. No link between
components is lost, and links inside a component do not change it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.bitmap import Bitmap
from docquarry.llm.common import WordHashes, batch_of, mix, rows_in, texts, tidy, weights
from docquarry.llm.components import components
from docquarry.session import scope, stage

WORDS = 5
PERCENT = 80
LEVELS = (1, 2, 3, 4, 6, 8)
VERIFY_COST = 20.0
FREQUENT = 1 << 18
FLUSH = 2_000_000
BUCKETS = 32
PIVOT_ROUNDS = 1
PROBE = 100
SEEN_SETS = 500_000
SIGNATURE = 16
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Shingler:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self, words: int = WORDS):
        self.words, self.hashes, self.weights = words, WordHashes(), weights(words)

    def set_of(self, text: str) -> np.ndarray:
        found = self.hashes.of(text.encode().translate(LOWER).split())
        n = len(found)
        if n == 0:
            return found
        if n < self.words:
            whole = (found * self.weights[:n]).sum(dtype=np.uint64) + np.uint64(n)
            return mix(np.array([whole], dtype=np.uint64))
        total = found[: n - self.words + 1] * self.weights[0]
        for i in range(1, self.words):
            total += found[i: n - self.words + 1 + i] * self.weights[i]
        return np.unique(mix(total))


def set_id(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    value = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >> 63 else value


def signature(shingles: np.ndarray) -> np.ndarray:
    """``SIGNATURE`` numbers of 64 bits, one bit per bucket: whether it holds an odd number of elements.

    Elements that two sets have in common leave no difference, so that the bits in which two signatures differ are
    at most as many as the elements that only one of the sets has.
    """
    size = 64 * SIGNATURE
    odd = np.bincount((shingles % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SUMMARY = "doc_id bigint, text_key bigint, n bigint, sid bigint, token bigint, df bigint, bits array<bigint>"


def _summary(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()),
                        ("sid", pa.int64()), ("token", pa.int64()), ("df", pa.int64()), ("bits", pa.list_(pa.int64()))])

    def frequent(sets: list[np.ndarray]) -> pa.RecordBatch | None:
        token, df = np.unique(np.concatenate(sets), return_counts=True)
        token, df = token[df >= 4], df[df >= 4]
        none = pa.nulls(len(token), pa.int64())
        return batch_of(schema, none, none, none, none, token.view(np.int64), df.astype(np.int64),
                        pa.nulls(len(token), pa.list_(pa.int64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, out, seen, sets, held = Shingler(words), [], set(), [], 0
        for doc_id, key, text in rows_in(batches, "doc_id", "text_key", "text"):
            s = shingler.set_of(text)
            sid = set_id(s) if len(s) else None
            out.append((doc_id, key, len(s), sid, None, None, signature(s) if len(s) else None))
            if len(out) >= 8_192:
                yield batch_of(schema, *zip(*out))
                out = []
            if sid is not None and sid not in seen:
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(sid)
                sets.append(s)
                held += len(s)
            if held >= FLUSH:
                yield frequent(sets)
                sets, held = [], 0
        if out:
            yield batch_of(schema, *zip(*out))
        if sets:
            yield frequent(sets)

    return run


def choose_level(df: np.ndarray, n: int, percent: int = PERCENT) -> tuple[int, int]:
    """Level and prefix length for a set whose sorted elements have document counts ``df``."""
    least = (percent * n + 99) // 100
    probes = np.cumsum(df)
    best = None
    for level in LEVELS:
        if level > least:
            break
        length = n - least + level
        seen = float(probes[length - 1])
        cost = length + seen + VERIFY_COST * seen / level
        if best is None or cost < best[0]:
            best = cost, level, length
    return best[1], best[2]


def _prefixes(words: int, percent: int, frequent):
    schema = pa.schema([("token", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("level", pa.int16()),
                        ("place", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.value
        shingler, seen, out, held = Shingler(words), set(), [], 0
        for (text,) in rows_in(batches, "text"):
            s = shingler.set_of(text)
            n = len(s)
            if n == 0 or (sid := set_id(s)) in seen:
                continue
            if len(seen) >= SEEN_SETS:
                seen.clear()
            seen.add(sid)
            df = np.zeros(n, dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                df = np.where(known[at] == s, counts[at], 0)
                order = np.argsort(df, kind="stable")
                s, df = s[order], df[order]
            level, length = choose_level(df, n, percent)
            out.append((s[:length].view(np.int64), sid, n, level))
            held += length
            if held >= 200_000:
                yield flat(out)
                out, held = [], 0
        if out:
            yield flat(out)

    def flat(rows) -> pa.RecordBatch:
        sizes = [len(r[0]) for r in rows]
        return batch_of(schema, np.concatenate([r[0] for r in rows]), np.repeat([r[1] for r in rows], sizes),
                        np.repeat(np.array([r[2] for r in rows], dtype=np.int32), sizes),
                        np.repeat(np.array([r[3] for r in rows], dtype=np.int16), sizes),
                        np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]))

    return run


def _sets(words: int, wanted):
    schema = pa.schema([("sid", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, out, held = Shingler(words), set(), [], 0
        for batch in batches:
            batch = batch.filter(pa.array(wanted.value.holds(batch.column("text_key").to_numpy())))
            for key, text in rows_in([batch], "text_key", "text"):
                if key in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(key)
                s = shingler.set_of(text)
                if not len(s):
                    continue
                out.append((set_id(s), s.tobytes()))
                held += len(s)
                if held >= 200_000:
                    yield batch_of(schema, *zip(*out))
                    out, held = [], 0
        if out:
            yield batch_of(schema, *zip(*out))

    return run


def _verify(percent: int):
    names = ("a", "b", "component", "component2")
    schema = pa.schema([(name, pa.int64()) for name in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for *pair, x, y in rows_in(batches, *names, "xs", "ys"):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                out.append(pair)
            if len(out) >= 8_192:
                yield batch_of(schema, *zip(*out))
                out = []
        if out:
            yield batch_of(schema, *zip(*out))

    return run


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    A-Z are lower-cased; words are runs of characters other than ASCII white space; a text of
    fewer than ``words`` words is one shingle, a text without words or null has none and is
    linked with nothing. Two documents link if ``100 * common >= percent * united``. The
    component is the least doc_id reachable by links. A doc_id that occurs in several rows gets
    a row for each; a null doc_id takes part and is never the least. An empty table gives no
    rows; other columns are ignored.

    The text is scanned in full twice, and once per round of verification for the texts of that round.
    It is never shuffled; shuffled are prefix elements, and the sets of pairs to be verified.
    """
    with scope(docs.sparkSession):
        return stage(_groups(docs, words, percent), "groups", keep=True)


def _groups(docs: DataFrame, words: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    narrow = texts(docs).withColumn("text_key", F.xxhash64("text"))
    summary = stage(narrow.mapInArrow(
        tidy(_summary(words)), SUMMARY), "summary")
    members = summary.where("n is not null").select("doc_id", "n", "sid")
    links = _links(spark, narrow.select("text_key", "text"), summary, words, percent)
    label = components(links)
    nodes = members.where("sid is not null").join(
        label.withColumnRenamed("node", "sid"), "sid", "left").select(
        "sid", "doc_id", F.coalesce("component", "sid").alias("component"))
    least = stage(nodes.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    named = stage(nodes.select("sid", "component").distinct().join(least, "component").select(
        "sid", "component_id"), "named")
    return members.join(named, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _links(spark: SparkSession, narrow: DataFrame, summary: DataFrame, words: int, percent: int) -> DataFrame:
    counted = summary.where("token is not null").groupBy("token").agg(F.sum("df").alias("df")).orderBy(
        F.desc("df"), "token").limit(FREQUENT).toArrow()
    known, counts = counted["token"].to_numpy().view(np.uint64), counted["df"].to_numpy()
    order = np.argsort(known)
    frequent = spark.sparkContext.broadcast((known[order], counts[order]))
    rows = narrow.select("text").mapInArrow(
        tidy(_prefixes(words, percent, frequent)), "token bigint, sid bigint, n int, level smallint, place int")
    by_token = Window.partitionBy("token")
    shared = stage(rows.withColumns({
        "low": F.min("sid").over(by_token), "high": F.max("sid").over(by_token),
    }).where("low <> high").select("token", "sid", "n", "level", "place").distinct(), "shared")
    bearer = summary.where("sid is not null").groupBy("sid").agg(F.min("text_key").alias("text_key"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stage(pairs, "pairs")
        sids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
        wanted = spark.sparkContext.broadcast(Bitmap(bearer.join(sids, "sid").select("text_key")))
        name = f"docquarry_sets_{uuid.uuid4().hex}"
        narrow.mapInArrow(tidy(_sets(words, wanted)), "sid bigint, shingles binary").dropDuplicates(["sid"]).write.bucketBy(
            BUCKETS, "sid").sortBy("sid").format("parquet").saveAsTable(name)
        sets = spark.table(name)
        one = pairs.join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("xs")), "a")
        two = one.join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("ys")), "b")
        found = stage(two.mapInArrow(tidy(_verify(percent)), "a bigint, b bigint, component bigint, component2 bigint"), "links")
        spark.sql(f"drop table {name}")
        return found

    # A set most of whose prefix is shared is near many others: it makes the best pivot.
    size = F.col("n") - F.ceil(percent * F.col("n") / F.lit(100)) + F.col("level")
    hubs = shared.groupBy("sid").agg((F.count("*") / F.first(size)).alias("hub"))
    open_rows = stage(shared.join(hubs, "sid").withColumn("component", F.col("sid")), "open")
    links = None
    for turn in range(PIVOT_ROUNDS):
        rank = F.struct(F.lit(0.0) if turn else -F.col("hub"), F.xxhash64("sid", F.lit(turn)))
        pivots = open_rows.groupBy("token").agg(
            F.min_by(F.struct("sid", "n", "level", "component"), rank).alias("p"))
        met = open_rows.join(pivots, "token").where("component <> p.component").select(
            F.col("sid").alias("a"), "n", "level", "component", F.col("p.sid").alias("b"), F.col("p.n").alias("n2"),
            F.col("p.level").alias("level2"), F.col("p.component").alias("component2"))
        best = _admitted(met, percent).groupBy("a").agg(
            F.max_by(F.struct("b", "component", "component2"), F.struct("common", "b")).alias("m")).select("a", "m.*")
        found = verified(best)
        links = found if links is None else links.union(found)
        open_rows = _still_open(open_rows, found)
    signs = summary.where("sid is not null").select("sid", "bits").dropDuplicates(["sid"])
    met = _met(open_rows.drop("hub").join(signs, "sid"), percent)
    likely = met.groupBy("a", "b", "component", "component2").agg(
        F.count("*").alias("common"), F.first("level").alias("level"), F.first("least").alias("least"),
    ).where("common >= level").drop("common", "level")
    whole = stage(shared.groupBy("sid").agg(F.collect_list("token").alias("tokens")), "prefixes")
    rest = likely.join(whole.select(F.col("sid").alias("a"), F.col("tokens").alias("xs")), "a").join(
        whole.select(F.col("sid").alias("b"), F.col("tokens").alias("ys")), "b").where(
        F.size(F.array_intersect("xs", "ys")) >= F.col("least")).select("a", "b", "component", "component2")
    return stage(links.union(verified(rest)).select("a", "b"), "links")


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """``a, component, b, component2, level, least`` for each prefix element that two sets share, if they may be similar.

    Of two similar sets, ``level`` elements in common lie among the first ``n - o + level`` of either,
    for every level up to the one that the whole prefixes allow; and their signatures differ in as many bits
    as ``n + n2 - 2 o`` at most.
    """
    rows = rows.select("token", "sid", "n", "level", "place", "component",
                       *[F.col("bits")[i].alias(f"bits{i}") for i in range(SIGNATURE)])
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    least = _least_shared(x("n"), x("level"), y("n"), y("level"), percent)
    level = F.least(least, F.greatest(
        F.least(x("level"), y("level")), F.ceil(F.least(x("n"), y("n")) / F.lit(PROBE))))
    o = _least_common(x("n"), y("n"), percent)
    apart = sum((F.bit_count(x(f"bits{i}").bitwiseXOR(y(f"bits{i}"))) for i in range(SIGNATURE)), F.lit(0))
    return rows.alias("x").join(rows.alias("y"), [
        x("token") == y("token"), x("sid") < y("sid"), x("component") != y("component"),
        x("place") < x("n") - o + level, y("place") < y("n") - o + level,
        100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n")),
        apart <= x("n") + y("n") - 2 * o,
    ]).select(x("sid").alias("a"), x("component").alias("component"), y("sid").alias("b"),
              y("component").alias("component2"), level.alias("level"), least.alias("least"))


def _still_open(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with the components that ``links`` join, of elements that still stand in more than one.

    Each component follows one link, and the link of where that leads. That may leave components apart that
    belong together, which costs later rounds some pairs and never a link.
    """
    step = stage(links.groupBy("component").agg(F.max("component2").alias("next")), "steps")
    after = step.select(F.col("component").alias("next"), F.col("next").alias("then"))
    lead = step.join(after, "next", "left").select("component", F.when(
        F.col("then") == F.col("component"), F.least("next", "component")
    ).otherwise(F.coalesce("then", "next")).alias("lead"))
    by_token = Window.partitionBy("token")
    named = rows.join(lead, "component", "left").withColumn("component", F.coalesce("lead", "component")).drop("lead")
    return stage(named.withColumns({
        "low": F.min("component").over(by_token), "high": F.max("component").over(by_token),
    }).where("low <> high").drop("low", "high"), "open")


def _least_common(n: Column, n2: Column, percent: int) -> Column:
    """Elements that similar sets of these sizes have in common at least."""
    return F.ceil(percent * (n + n2) / F.lit(100 + percent))


def _least_shared(n: Column, level: Column, n2: Column, level2: Column, percent: int) -> Column:
    """Elements that similar sets share within their prefixes at least.

    With ``o`` elements in common a set has at most ``n - o`` that the other lacks, and of the prefix that
    ends first, all elements in common lie in the other prefix too.
    """
    def side(size, own):
        return own + _least_common(n, n2, percent) - F.ceil(percent * size / F.lit(100))

    return F.least(side(n, level), side(n2, level2))


def _admitted(met: DataFrame, percent: int) -> DataFrame:
    """``a, b, component, component2, common`` of the pairs that share enough prefix elements; a row of ``met`` is one of them."""
    least = _least_shared(F.col("n"), F.col("level"), F.col("n2"), F.col("level2"), percent)
    return met.where(100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")).groupBy(
        "a", "b", "component", "component2").agg(
        F.count("*").alias("common"), F.first(least).alias("least"),
    ).where("common >= least").drop("least")
