"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into units that no piece of the model crosses. The distinct units of the corpus
become a lattice: their substrings of bounded length are exploded and joined to the piece table,
edges are grouped by unit, and a fold over the edges picks the path. A unigram model takes the
Viterbi fold, the path of the highest total score, as a higher-order aggregate. A merge (BPE) model
defines its result by the order of its merges, not by a total, so its fold merges the best edge of
the same lattice until none is left; a Viterbi fold would give other pieces than the model's own.

Every distinct unit is encoded once, however often it occurs, and goes back to the blocks of texts that
hold it. One shuffle brings the occurrences of a unit together, a second one the texts of a block and
its units; both travel compressed.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Batches, batch_of, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONGEST_UNIT = 48
BLOCK_CHARS = 13_000_000
HELD_UNITS = 300_000
KNOWN_WORDS = 400_000
#: Leading characters of a substring that tell how long a piece beginning with them can be.
HEAD = 3
_LETTER = r"A-Za-z\u00c0-\u1fff\u2070-\u2580\u2582-\U0010ffff"
#: From fine to coarse; the first that no piece crosses is used.
CUTS = (rf"{SPACE}*[{_LETTER}]+|{SPACE}*[^{_LETTER}{SPACE}]+|{SPACE}+", rf"{SPACE}*[^{SPACE}]+|{SPACE}+", r"(?s).+")
NORMAL, UNKNOWN, BYTE, UNIGRAM = 1, 2, 6, 1


@dataclass
class Model:
    """A piece table; ``kinds`` are the piece types of the model file format."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    unigram: bool
    prefix: bool

    def __post_init__(self):
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.cut = next(c for c in CUTS if all(re.fullmatch(c, p) for p in self.ids))
        self.longest = max(map(len, self.ids), default=1)

    def fallback(self, char: str) -> list[int]:
        """Pieces of a character that has none: its bytes, or the unknown piece."""
        data = char.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in data] if self.bytes else [self.unknown]


def read_model(path: str = MODEL) -> Model:
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as data:
        m.ParseFromString(data.read())
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models that leave characters as they are")
    return Model([p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces],
                 m.trainer_spec.model_type == UNIGRAM, m.normalizer_spec.add_dummy_prefix)


PACKED = "block bigint, units binary"
#: Id + 1 (24 bits), length (6 bits) and whether the unit begins; above them the code + 1 of a character that is no piece.
_EDGE = """
cast((id + 1) | shiftleft(n, 24) | if(i = 1 and n = 1, 1073741824, 0) as bigint)
  | shiftleft(if(id = -1 and part <> '', cast(ascii(part) + 1 as bigint), 0L), 32) as edge
"""
_VITERBI = """
aggregate(sequence(1, n), array(struct(0.0D as score, array(0) as cuts)), (done, j) ->
  concat(done, array(element_at(transform(array(array_max(transform(
    filter(concat(edges, array(struct(j - 1 as a, j as b, unknown as score, -1 as id))), e -> e.b = j),
    e -> struct(done[e.a].score + e.score as score, e.a as a)))),
    best -> struct(best.score as score, concat(done[best.a].cuts, array(j)) as cuts)), 1))),
  done -> element_at(done, -1).cuts)
"""
_IDS = """
transform(sequence(1, size(cuts) - 1), k -> coalesce(
  get(filter(edges, e -> e.a = cuts[k - 1] and e.b = cuts[k]).id, 0),
  -ascii(substring(unit, cuts[k - 1] + 1, 1)) - 1))
"""


def _join_key(names: Collection[str]) -> Callable[[Column], Column]:
    """A column by which strings are joined to ``names``: their hash, a long, or where two of ``names`` share it they themselves."""
    hashes = {xxhash.xxh64_intdigest(name.encode(), 42) for name in names}
    return F.xxhash64 if len(hashes) == len(names) else lambda c: c


def _edges(units: DataFrame, model: Model) -> DataFrame:
    """``unit, blocks, i, n, part, id, score``: the substrings of ``units(unit, blocks)`` that are pieces, and every single character.

    ``part`` has ``n`` characters from the ``i``-th on; a character that is no piece has -1 for ``id``. Only lengths of pieces
    that begin with the same ``HEAD`` characters are exploded, the shorter ones always. A substring meets pieces by a hash, then
    as it is. A unit's rows follow one another by ``i`` and ``n``; where it has more blocks than characters, empty ones follow.
    """
    spark = units.sparkSession
    lengths: dict[str, set[int]] = {}
    for piece in model.ids:
        if len(piece) >= HEAD:
            lengths.setdefault(piece[:HEAD], set(range(1, HEAD))).add(len(piece))
    of_head, of_piece = _join_key(lengths), _join_key(model.ids)
    heads = spark.createDataFrame([(h, sorted(n)) for h, n in lengths.items()], "head string, lengths array<int>").select(
        of_head(F.col("head")).alias("head"), "lengths")
    table = spark.createDataFrame(
        [(p, i, float(model.scores[i])) for p, i in model.ids.items()], "piece string, id int, score double").select(
        of_piece(F.col("piece")).alias("key"), "piece", "id", "score")
    starts = units.select("unit", "blocks", F.explode(F.expr("sequence(1, greatest(char_length(unit), size(blocks)))")).alias("i"))
    spans = starts.join(F.broadcast(heads), of_head(F.expr(f"substring(unit, i, {HEAD})")) == F.col("head"), "left").select(
        "unit", "blocks", "i", F.explode(F.coalesce("lengths", F.array(*map(F.lit, range(1, HEAD))))).alias("n")
    ).where("n = 1 or i + n - 1 <= char_length(unit)")
    found = spans.select("unit", "blocks", "i", "n", F.expr("substring(unit, i, n)").alias("part")).join(
        F.broadcast(table), of_piece(F.col("part")) == F.col("key"), "left")
    return found.withColumn("id", F.expr("if(piece = part, id, null)")).where("n = 1 or id is not null").select(
        "unit", "blocks", "i", "n", "part", F.coalesce("id", F.lit(-1)).alias("id"), "score")


def encode_units(units: DataFrame, model: Model) -> DataFrame:
    """``block, units``: tables of ``unit, ids`` for ``units(unit, blocks)``; a negative id ``-c - 1`` is a character without a piece.

    Exploding keeps a unit's rows together and in order, and the joins send tables as large as the model, so
    nothing is shuffled. To the merge fold an edge goes as one number, and each of a unit's blocks along with a single
    character, since what rows of strings and lists cost on the way to Python is more than the join.
    """
    edges = _edges(units, model)
    if not model.unigram:
        fold = _merge_fold(model)
        return edges.selectExpr(_EDGE, "if(n = 1, get(blocks, i - 1), null) as block").mapInArrow(
            tidy(lambda batches: _packed(fold(batches))), PACKED)
    edges = edges.where("i <= char_length(unit)").select(
        "unit", F.expr("if(i = 1 and n = 1, blocks, null)").alias("blocks"), "i", F.expr("i + n - 1").alias("j"), "id", "score")
    grouped = edges.groupBy("unit").agg(F.flatten(F.collect_list("blocks")).alias("blocks"), F.collect_set(
        F.when(F.col("id") >= 0, F.struct((F.col("i") - 1).alias("a"), F.col("j").alias("b"), "score", "id"))).alias("edges"))
    unknown = min(model.scores, default=0.0) - 10.0
    fold = _VITERBI.replace("unknown", f"cast({unknown!r} as double)")
    return grouped.withColumn("n", F.char_length("unit")).withColumn("cuts", F.expr(fold)).select(
        "unit", "blocks", F.expr(_IDS).alias("ids")).mapInArrow(tidy(_packed), PACKED)


class _Edges:
    """Edges of many units by their places: units stand one after the other, each with a place more than it has characters."""

    def __init__(self, start: np.ndarray, end: np.ndarray, score: np.ndarray, ids: np.ndarray):
        key = start * 64 + (end - start)
        order = np.argsort(key)
        self.key, self.cost, self.ids = key[order], -score[order], ids[order]

    def find(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the edges are, and which there are."""
        key = start * 64 + (end - start)
        if not len(self.key):
            return np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, self.key[at] == key

    def costs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        at, there = self.find(start, end)
        return np.where(there, self.cost[at], np.inf) if len(self.cost) else np.full(len(at), np.inf)


def merged(units: list[str], edges: _Edges) -> tuple[np.ndarray, np.ndarray]:
    """Paths of many units through their edges, as ids and the ends of the units' shares of them.

    In every round each unit takes the best edge over two neighbours, the first of equal ones; a unit without any is done.
    """
    sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    ends = np.cumsum(sizes + 1) - 1
    first = ends - sizes
    places = int(ends[-1]) + 1
    left, right = np.arange(places) - 1, np.arange(places) + 1
    inner = np.ones(places, dtype=bool)
    inner[first] = inner[ends] = False
    kept = np.ones(places, dtype=bool)
    cost = np.full(places, np.inf)
    middle = np.flatnonzero(inner)
    cost[middle] = edges.costs(left[middle], right[middle])
    active = np.flatnonzero(sizes > 1)
    while len(active):
        # Places of the units that go on, each unit a run.
        lengths = sizes[active] + 1
        runs = np.cumsum(lengths) - lengths
        own = np.repeat(first[active] - runs, lengths) + np.arange(int(lengths.sum()))
        while True:
            now = cost[own]
            best = np.minimum.reduceat(now, runs)
            go = np.isfinite(best)
            if not go.any():
                active = active[:0]
                break
            hits = np.flatnonzero(now == np.repeat(np.where(go, best, np.nan), lengths))
            run = np.searchsorted(runs, hits, "right") - 1
            at = own[hits[np.flatnonzero(np.diff(run, prepend=-1))]]
            a, c = left[at], right[at]
            kept[at], cost[at] = False, np.inf
            right[a], left[c] = c, a
            for near in (a[inner[a]], c[inner[c]]):
                cost[near] = edges.costs(left[near], right[near])
            if 2 * int(go.sum()) < len(active):
                active = active[go]
                break
    kept[ends] = False
    begins = np.flatnonzero(kept)
    at, there = edges.find(begins, right[begins])
    unit = np.searchsorted(ends, begins)
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    out = -codes[begins - unit] - 1 if len(codes) else np.zeros(0, dtype=np.int64)
    if len(edges.ids):
        out = np.where(there, edges.ids[at], out)
    return out.astype(np.int32), np.cumsum(np.bincount(unit, minlength=len(units)))


def _merge_fold(model: Model) -> Batches:
    """``unit, blocks, ids`` from rows of ``edge, block``."""
    schema = pa.schema([("unit", pa.string()), ("blocks", pa.list_(pa.int64())), ("ids", pa.list_(pa.int32()))])
    scores = np.array(model.scores, dtype=np.float64)
    # Of ids of single characters; the others are never asked for.
    codes = np.zeros(len(model.pieces), dtype=np.int64)
    for piece, i in model.ids.items():
        codes[i] = ord(piece[0])

    def folded(edge: np.ndarray, block: pa.Array) -> pa.RecordBatch:
        first = edge >> 30 & 1 == 1
        starts = np.flatnonzero(first)
        ids, size, code = (edge & (1 << 24) - 1) - 1, edge >> 24 & 63, edge >> 32
        char = (size == 1) & ((ids >= 0) | (code > 0))
        own = np.where(ids[char] >= 0, codes[ids[char]], code[char] - 1)
        text = own.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        ends = np.cumsum(np.add.reduceat(char, starts, dtype=np.int64)).tolist()
        units = [text[a:b] for a, b in zip([0, *ends], ends)]
        # Characters stand one after the other, each unit with a place more than it has of them.
        place = np.cumsum(char) - 1 + np.cumsum(first) - 1
        real = ids >= 0
        values, cuts = merged(units, _Edges(place[real], (place + size)[real], scores[ids[real]], ids[real]))
        held = np.add.reduceat(block.is_valid().to_numpy(zero_copy_only=False), starts, dtype=np.int64)
        blocks, lists = (
            pa.ListArray.from_arrays(pa.array(np.append(0, n).astype(np.int32)), x)
            for n, x in ((np.cumsum(held), block.drop_null()), (cuts, pa.array(values))))
        return batch_of(schema, units, blocks, lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if waiting is not None:
                table = pa.concat_tables([waiting, table])
            edge = table.column("edge").to_numpy()
            starts = np.flatnonzero(edge >> 30 & 1)
            if len(starts) > 1:
                yield folded(edge[:starts[-1]], table.column("block").slice(0, starts[-1]).combine_chunks())
                table = table.slice(starts[-1])
            waiting = table.combine_chunks()
        if waiting is not None and waiting.num_rows:
            yield folded(waiting.column("edge").to_numpy(), waiting.column("block").combine_chunks())

    return run


def merge_long(unit: str, model: Model) -> list[int]:
    """The merge rule for one long unit, in time proportional to its length times a logarithm."""
    ids, scores = model.ids, model.scores
    parts: list[str | None] = list(unit)
    left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < len(parts):
            both = parts[i] + parts[j]
            if both in ids:
                heapq.heappush(heap, (-scores[ids[both]], i, j, both))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if parts[i] is None or right[i] != j or parts[j] is None or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, None
        right[i] = right[j]
        if right[i] < len(parts):
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out = []
    for part in parts:
        if part is not None:
            out.extend([ids[part]] if part in ids else model.fallback(part))
    return out


def viterbi_long(unit: str, model: Model) -> list[int]:
    """The highest total score for one long unit, in time proportional to its length."""
    unknown = min(model.scores, default=0.0) - 10.0
    best: list[tuple[float, int, int]] = [(0.0, 0, -1)]
    for j in range(1, len(unit) + 1):
        options = [(best[j - 1][0] + unknown, j - 1, -1)]
        for i in range(max(0, j - model.longest), j):
            found = model.ids.get(unit[i:j])
            if found is not None:
                options.append((best[i][0] + model.scores[found], i, found))
        best.append(max(options))
    out, j = [], len(unit)
    while j:
        _, i, found = best[j]
        out.append([found] if found >= 0 else model.fallback(unit[i:j]))
        j = i
    return [x for part in reversed(out) for x in part]


class Cutter:
    """Units of a text, and of its words where words can be treated on their own."""

    def __init__(self, model: Model):
        self.find = re.compile(model.cut).findall
        self.by_word = model.prefix and model.cut != CUTS[-1]
        self.prefix = SPACE if model.prefix else ""

    def words(self, text: str) -> list[str]:
        """Strings that are encoded one by one: words without the space ahead of them, or a whole text with its marks."""
        if not text:
            return []
        if not self.by_word or SPACE in text or "  " in text or text[-1] == " " or text[0] == " ":
            return [self.prefix + text.replace(" ", SPACE)]
        return text.split(" ")

    def units(self, words: set[str]) -> set[str]:
        """Distinct units of the words; those without marks of their own are cut in one go."""
        plain = [w for w in words if w[0] != SPACE] if self.by_word else []
        found = {u for w in words.difference(plain) for u in self.find(w)}
        for start in range(0, len(plain), 20_000):
            found.update(self.find("".join([SPACE + w for w in plain[start:start + 20_000]])))
        return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Runs of whole rows of about ``BLOCK_CHARS``, each with a name made from its texts."""
    parts, size, name = [], 0, xxhash.xxh3_64()

    def done() -> tuple[int, pa.Table]:
        return name.intdigest() - (1 << 63), pa.Table.from_batches(parts)

    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            parts.append(part)
            for text in part.column("text").to_pylist():
                data = (text or "").encode()
                name.update(data)
                name.update(b"\xff")
                size += len(data)
            if size >= BLOCK_CHARS:
                yield done()
                parts, size, name = [], 0, xxhash.xxh3_64()
    if parts:
        yield done()


def _block_units(shared):
    schema = pa.schema([("block", pa.int64()), ("unit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(shared.value)
        for block, table in _blocks(batches):
            words: set[str] = set()
            for chunk in table.column("text").chunks:
                for text in chunk.to_pylist():
                    words.update(cutter.words(text or ""))
            units = sorted(u for u in cutter.units(words) if len(u) <= LONGEST_UNIT)
            for start in range(0, len(units), 50_000):
                some = units[start:start + 50_000]
                yield batch_of(schema, np.full(len(some), block), some)
            del table, words, units

    return run


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``unit, blocks`` from sorted ``unit, block`` rows; a unit of very many blocks comes in several rows."""
    schema = pa.schema([("unit", pa.string()), ("blocks", pa.list_(pa.int64()))])
    for batch in batches:
        if not batch.num_rows:
            continue
        unit, block = batch.column("unit"), batch.column("block")
        other = pc.not_equal(unit.slice(1), unit.slice(0, len(unit) - 1)).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(other) + 1])
        ends = np.append(starts, len(unit)).astype(np.int32)
        yield batch_of(schema, unit.take(pa.array(starts)), pa.ListArray.from_arrays(pa.array(ends), block))


def _compressed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
    with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _units_packed(units: pa.Table) -> bytes:
    """Encoded units as one compressed row; sizes take less room than the offsets of strings and lists."""
    unit, ids = (units.column(c).combine_chunks() for c in ("unit", "ids"))

    def row(values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return _compressed(pa.table({
        "units": pa.array(["".join(unit.to_pylist())], pa.string()), "sizes": row(pc.utf8_length(unit).cast(pa.uint16())),
        "counts": row(pc.list_value_length(ids).cast(pa.uint16())), "ids": row(ids.flatten())}))


def _units_of(blob: pa.Scalar) -> pa.Table:
    """``unit, ids`` of a row of ``_units_packed``."""
    row = pa.ipc.open_stream(blob.as_buffer()).read_all()
    text = row.column("units")[0].as_py()
    sizes, counts, ids = (row.column(c).combine_chunks().flatten() for c in ("sizes", "counts", "ids"))
    ends = np.cumsum(sizes.to_numpy(), dtype=np.int64).tolist()
    offsets = np.append(0, np.cumsum(counts.to_numpy(), dtype=np.int64)).astype(np.int32)
    return pa.table({"unit": pa.array([text[a:b] for a, b in zip([0, *ends], ends)], pa.string()),
                     "ids": pa.ListArray.from_arrays(pa.array(offsets), ids)})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encoded units as compressed tables, one for each block and some hundred thousand occurrences."""
    schema = pa.schema([("block", pa.int64()), ("units", pa.binary())])
    waiting, held = [], 0

    def packed() -> pa.RecordBatch:
        table = pa.Table.from_batches(waiting).combine_chunks()
        blocks = table.column("blocks").chunk(0)
        row = np.repeat(np.arange(table.num_rows), pc.list_value_length(blocks).to_numpy(zero_copy_only=False))
        block = blocks.flatten().to_numpy()
        order = np.argsort(block, kind="stable")
        names, starts = np.unique(block[order], return_index=True)
        parts = np.split(row[order], starts[1:])
        units = table.select(["unit", "ids"])
        return batch_of(schema, names, [_units_packed(units.take(pa.array(part))) for part in parts])

    for batch in batches:
        waiting.append(batch)
        held += len(batch.column("blocks").flatten())
        if held >= HELD_UNITS:
            yield packed()
            waiting, held = [], 0
    if held:
        yield packed()


def _block_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.int64()), ("rows", pa.binary())])
    for block, table in _blocks(batches):
        yield batch_of(schema, [block], [_compressed(table)])
        del table


def _slices(blob: pa.Scalar) -> Iterator[pa.Table]:
    """A compressed table, some rows at a time."""
    table = pa.ipc.open_stream(blob.as_buffer()).read_all()
    for start in range(0, table.num_rows, 256):
        yield table.slice(start, 256)


class _Encoder(dict):
    """Ids of words as bytes of 32-bit numbers, put together from the encoded units of a block.

    A unit that is a word behind one space mark stands here under that word, every other in ``units``; up to
    ``KNOWN_WORDS`` words of several units (``made``) are remembered.
    """

    def __init__(self, model: Model, cutter: Cutter, units: pa.Table | None = None):
        super().__init__()
        self.model, self.cutter, self.units, self.made = model, cutter, {}, []
        if units is not None:
            self.add(units)

    def bare(self, unit: str) -> bool:
        """Whether a unit is a word behind one space mark."""
        return self.cutter.by_word and unit[0] == SPACE and len(unit) > 1 and unit[1] != SPACE

    def add(self, units: pa.Table) -> None:
        """Encoded units, ``unit, ids``, that words may be made of."""
        ids = units.combine_chunks().column("ids").chunk(0)
        values, offsets = ids.values.to_numpy().astype(np.int32), ids.offsets.to_numpy().astype(np.int64)
        data, cuts = values.tobytes(), (4 * offsets).tolist()
        encoded = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        for at in np.unique(np.searchsorted(offsets, np.flatnonzero(values < 0), "right") - 1).tolist():
            own = values[offsets[at]:offsets[at + 1]].tolist()
            encoded[at] = np.array(
                [x for i in own for x in (self.model.fallback(chr(-i - 1)) if i < 0 else [i])], dtype=np.int32).tobytes()
        for unit, value in zip(units.column("unit").to_pylist(), encoded):
            if self.bare(unit):
                self[unit[1:]] = value
            else:
                self.units[unit] = value

    def __missing__(self, word: str) -> bytes:
        whole = SPACE + word if self.cutter.by_word and word[0] != SPACE else word
        value = b"".join(map(self.of, self.cutter.find(whole)))
        if len(word) <= LONGEST_UNIT:
            if len(self.made) >= KNOWN_WORDS:
                for old in self.made:
                    del self[old]
                self.made = []
            self.made.append(word)
            self[word] = value
        return value

    def of(self, unit: str) -> bytes:
        value = self.get(unit[1:]) if self.bare(unit) else self.units.get(unit)
        return self.unit(unit) if value is None else value

    def unit(self, unit: str) -> bytes:
        if len(unit) <= LONGEST_UNIT:
            raise ValueError("a block changed between two scans of the documents")
        long = viterbi_long if self.model.unigram else merge_long
        return np.array(long(unit, self.model), dtype=np.int32).tobytes()


class _Decoder:
    """Texts that lists of ids stand for, by the bytes of their pieces."""

    def __init__(self, model: Model):
        back = [bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(SPACE, " ").encode("utf-8", "surrogatepass")
                if k == NORMAL else b"" for p, k in zip(model.pieces, model.kinds)]
        self.prefix = model.prefix
        self.data = pa.array(back, pa.large_binary())

    def texts(self, lists: pa.ListArray) -> list[str | None]:
        found = self.data.take(lists.flatten())
        ends = np.frombuffer(found.buffers()[1], dtype=np.int64)[found.offset:found.offset + len(found) + 1]
        data = found.buffers()[2].to_pybytes() if len(found) and found.buffers()[2] else b""
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        cuts = ends[np.append(0, np.cumsum(counts))].tolist()
        out = []
        for known, a, b in zip(lists.is_valid().to_pylist(), cuts, cuts[1:]):
            # A space mark may also have been put together from bytes.
            text = data[a:b].decode("utf-8", "replace").replace(SPACE, " ") if known else None
            out.append(text[1:] if text and self.prefix and text[0] == " " else text)
        return out


def encode(docs: DataFrame, model: Model | None = None, decoded: bool = False) -> DataFrame:
    """All rows and columns of ``docs(text, ...)`` with ``n_tokens`` and ``token_ids``, and as told ``decoded``.

    The ids are those of the model's own encoder, a space put ahead of the text if the model says so.
    Null and empty texts have no tokens; a character without a piece becomes its bytes, or the
    unknown piece where the model has none for bytes. Repeated rows are all kept; columns named like the new
    ones are replaced; an empty table gives no rows. Units longer than ``LONGEST_UNIT`` characters are folded by the same rule
    outside the lattice, since a fold over arrays costs the square of a unit's length. ``decoded`` is what ``decode`` makes of
    the ids, without another pass of the rows.

    ``docs`` is scanned twice, so its rows must come in the same order each time, as from a scan of files; a change
    ends the job with an error.
    """
    model = model or read_model()
    own = docs.drop("n_tokens", "token_ids", *["decoded"] * decoded)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = own.select("text").mapInArrow(tidy(_block_units(shared)), "block bigint, unit string")
    sorted_units = held.repartition("unit").sortWithinPartitions("unit")
    holders = sorted_units.mapInArrow(tidy(_holders), "unit string, blocks array<bigint>")
    units = encode_units(holders, model)
    texts = own.mapInArrow(tidy(_block_texts), "block bigint, rows binary")
    schema = own.withColumns({"n_tokens": F.lit(0).cast("bigint"),
                              "token_ids": F.expr("cast(array() as array<int>)"),
                              **({"decoded": F.lit("").cast("string")} if decoded else {})}).schema

    both = texts.selectExpr("block", "cast(null as binary) as units", "rows").unionByName(
        units.selectExpr("block", "units", "cast(null as binary) as rows"))
    # The units of a block come ahead of its texts.
    return both.repartition("block").sortWithinPartitions("block", F.col("units").isNull()).mapInArrow(
        tidy(_encoded(shared, decoded)), schema)


def _encoded(shared, decoded: bool):
    """Texts with their ids from rows of ``block, units, rows`` in order, some rows at a time."""
    def made(encoder: _Encoder, back: _Decoder | None, table: pa.Table) -> list[pa.RecordBatch]:
        ids, ends = [], [0]
        for text in table.column("text").to_pylist():
            ids.append(b"".join(map(encoder.__getitem__, encoder.cutter.words(text or ""))))
            ends.append(ends[-1] + len(ids[-1]) // 4)
        flat = np.frombuffer(b"".join(ids), dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(flat, pa.int32()))
        table = table.append_column("n_tokens", pa.array(np.diff(ends).astype(np.int64))).append_column("token_ids", lists)
        if back:
            table = table.append_column("decoded", pa.array(back.texts(lists), pa.string()))
        return table.to_batches()

    def checked(met: bool) -> None:
        if not met:
            raise ValueError("a block changed between two scans of the documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(shared.value)
        back = _Decoder(shared.value) if decoded else None
        encoder, now, met = None, None, True
        for batch in batches:
            for block, units, rows in zip(*(batch.column(c) for c in ("block", "units", "rows"))):
                if encoder is None or block != now:
                    checked(met)
                    encoder, now, met = _Encoder(shared.value, cutter), block, False
                if units.is_valid:
                    encoder.add(_units_of(units))
                    continue
                met = True
                for table in _slices(rows):
                    yield from made(encoder, back, table)
        checked(met)

    return run


def decode(encoded: DataFrame, model: Model | None = None) -> DataFrame:
    """All rows and columns with ``decoded``: the text that ``token_ids`` stand for.

    Byte pieces are put together and read as UTF-8; the space ahead of the text is taken off
    again. Null ids give null. A column named ``decoded`` is replaced.
    """
    model = model or read_model()
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    own = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = _Decoder(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(back.texts(part.column("token_ids")), pa.string())],
                                                 names=[*part.schema.names, "decoded"])

    return own.mapInArrow(run, own.withColumn("decoded", F.lit("").cast("string")).schema)
