"""Benchmark decontamination by spaced seeds.

Fixed masks say which words of a window count; the others may be substituted. Every overlap that
counts is met by a mask: one of 26 words or more can be halved, one half being alike enough, and one
of fewer holds 13 words with 2 substitutions at most, 15 with 3, 20 with 4 or 25 with 5; of these no
choice of places avoids all masks. Seeds of the
benchmark meet seeds of the documents by an equi-join on their hash: the benchmark side is
bounded by ``BLOCK_WORDS`` and goes to every task, a larger benchmark takes several passes
over the documents. At every hit the two texts are laid over each other, and the longest window
that is alike enough is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import CACHED_WORDS, batch_of, by_size, mix, rows_in, texts, tidy, weights

MASKS = ("11101011", "1101100111", "110010110011", "1011010011011", "1101000010111", "1111000100011")
LEAST_WORDS = 13
LEAST_ALIKE = (4, 5)
BLOCK_WORDS = 2_000_000
CHUNK_CHARS = 400_000
TABLE_BITS = 22
HITS = 1_000_000
_EDGE = re.compile(r"^\W+|\W+$")


class Words(dict):
    """Hash of a lower-cased word without punctuation at its ends; 0 if nothing is left."""

    def __missing__(self, word: str) -> int:
        bare = _EDGE.sub("", word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = (xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass")) | 1) if bare else 0
        return value

    def of(self, text: str) -> np.ndarray:
        words = text.lower().split()
        found = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
        return found[found != 0]


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """One hash per window of ``words``; the words under a 0 of ``mask`` do not count."""
    places = [i for i, c in enumerate(mask) if c == "1"]
    count = len(words) - len(mask) + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(count, xxhash.xxh3_64_intdigest(mask.encode()), dtype=np.uint64)
    for place, weight in zip(places, weights(len(places))):
        total += words[place: place + count] * weight
    return mix(total)


def longest_window(same: np.ndarray) -> tuple[int, int, int] | None:
    """Length, matches and start of the longest window that is long and alike enough.

    ``same`` says for every place of a diagonal whether the two words are equal. Of windows of one
    length that with most matches counts, then the last.
    """
    if len(same) < LEAST_WORDS:
        return None
    matches = np.concatenate([[0], np.cumsum(same)])
    level = LEAST_ALIKE[1] * matches - LEAST_ALIKE[0] * np.arange(len(matches))
    starts = np.searchsorted(-np.minimum.accumulate(level), -level, "left")
    lengths = np.arange(len(level)) - starts
    length = int(lengths.max())
    if length < LEAST_WORDS:
        return None
    start = starts[lengths == length]
    same_words = matches[start + length] - matches[start]
    best = np.flatnonzero(same_words == same_words.max())[-1]
    return length, int(same_words[best]), int(start[best])


class Matcher:
    """The seeds of one block of benchmark items, ready to be met by documents."""

    def __init__(self, items: list[tuple[int, str]]):
        words = Words()
        self.items = [(item, words.of(text or "")) for item, text in items]
        self.tables = []
        for mask in MASKS:
            keys, owners, places = [], [], []
            for number, (_, found) in enumerate(self.items):
                own = seeds(found, mask)
                keys.append(own)
                owners.append(np.full(len(own), number, dtype=np.int32))
                places.append(np.arange(len(own), dtype=np.int32))
            keys = np.concatenate([np.zeros(0, dtype=np.uint64), *keys])
            order = np.argsort(keys, kind="stable")
            present = np.zeros(1 << TABLE_BITS, dtype=bool)
            present[keys >> np.uint64(64 - TABLE_BITS)] = True
            self.tables.append((mask, present, keys[order], np.concatenate([[0], *owners])[1:][order],
                                np.concatenate([[0], *places])[1:][order]))

    def hits(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions in ``words``, item numbers and positions in the items, up to about ``HITS`` at a time."""
        for mask, present, keys, owners, places in self.tables:
            own = seeds(words, mask)
            at = np.flatnonzero(present[own >> np.uint64(64 - TABLE_BITS)])
            own = own[at]
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            met = np.flatnonzero(high > low)
            at, low, count = at[met], low[met], (high - low)[met]
            part = np.cumsum(count) // HITS
            for p in np.unique(part):
                first, last = np.searchsorted(part, p, "left"), np.searchsorted(part, p, "right")
                n = count[first:last]
                entry = np.arange(n.sum()) + np.repeat(low[first:last] - np.cumsum(n) + n, n)
                yield np.repeat(at[first:last], n), owners[entry], places[entry]

    def of_texts(self, texts_: list[str], words: Words) -> Iterator[tuple[int, dict[int, tuple[int, int, int]]]]:
        """Texts that have an overlap: their number, and per item number length, matching words and start of the best.

        A hit names a diagonal, a way to lay text and item over each other; every such diagonal is judged whole.
        """
        runs = [words.of(t or "") for t in texts_]
        ends = np.cumsum([len(r) for r in runs])
        starts = ends - [len(r) for r in runs]
        everything = np.concatenate([np.zeros(0, dtype=np.uint64), *runs])
        diagonals: np.ndarray | None = None
        for at, owner, place in self.hits(everything):
            text = np.searchsorted(ends, at, "right")
            found = np.stack([text, owner, at - starts[text] - place], axis=1)
            diagonals = _distinct(found if diagonals is None else np.concatenate([diagonals, found]))
        best: dict[int, dict[int, tuple[int, int, int]]] = {}
        for text, owner, shift in ([] if diagonals is None else diagonals.tolist()):
            run, item = runs[text][max(0, shift):], self.items[owner][1][max(0, -shift):]
            n = min(len(run), len(item))
            found = longest_window(run[:n] == item[:n])
            if found:
                length, same, start = found
                of_text = best.setdefault(text, {})
                of_text[owner] = max(of_text.get(owner, (0, 0, 0)), (length, same, start + max(0, shift)))
        yield from best.items()


def _distinct(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort(rows.T)]
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in blocks of about ``BLOCK_WORDS`` words, each small enough for a task."""
    narrow = texts(benchmark, "item_id")
    total = narrow.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    count = 1 + total // BLOCK_WORDS
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    return [narrow.where(block == i) for i in range(count)]


def _shared(block: DataFrame):
    rows = [(r.item_id, r.text) for r in block.collect()]
    return block.sparkSession.sparkContext.broadcast(Matcher(rows))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, overlap_words, same_words, start_word`` per contaminated document and item.

    The longest window of at least ``LEAST_WORDS`` words of the two texts, laid over each other in any
    way, of which at least ``LEAST_ALIKE`` are the same; its ends may be substituted too. Words are lower-cased and lose punctuation at their ends; words of
    punctuation only do not count. Null and empty texts overlap with nothing, nor do items of
    fewer than ``LEAST_WORDS`` words. A repeated document has rows for each repeat, a repeated item likewise;
    other columns are ignored; an empty table on either side gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("overlap_words", pa.int32()),
                        ("same_words", pa.int32()), ("start_word", pa.int32())])

    def task(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher, words = shared.value, Words()
            for rows in by_size(rows_in(batches, "doc_id", "text"), lambda r: len(r[1]), CHUNK_CHARS):
                out = [
                    (rows[text][0], matcher.items[number][0], *found)
                    for text, best in matcher.of_texts([r[1] for r in rows], words)
                    for number, found in best.items()
                ]
                if out:
                    yield batch_of(schema, *zip(*out))
        return run

    results = [
        texts(docs).mapInArrow(tidy(task(_shared(block))), "doc_id bigint, item_id bigint, overlap_words int, "
                               "same_words int, start_word int")
        for block in blocks(benchmark)
    ]
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``overlaps`` does not name, all columns kept; nothing is shuffled."""
    def task(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher, words = shared.value, Words()
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    found = {t for t, _ in matcher.of_texts(part.column("text").to_pylist(), words)}
                    keep = [i for i in range(part.num_rows) if i not in found]
                    yield part if len(keep) == part.num_rows else part.take(pa.array(keep, pa.int64()))
        return run

    out = docs
    for block in blocks(benchmark):
        out = out.mapInArrow(tidy(task(_shared(block))), docs.schema)
    return out
