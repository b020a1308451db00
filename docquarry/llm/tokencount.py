"""Token counts by a linear longest-match automaton.

A vocabulary becomes a trie of bytes. Every state carries a failure link and the number of
pieces that are complete once the link is taken, so one pass over a word counts the pieces
of its greedy longest-match split without building any piece and without going back. The
vocabulary is the only thing sent to tasks; its size does not depend on the data.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docquarry.llm.common import CACHED_WORDS, batch_of, rows_in, texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONGEST_CACHED = 64


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a rank file: one base64 piece and its rank per line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Counts pieces of a byte string; a byte that is no piece counts as one unknown piece."""

    def __init__(self, pieces: Iterable[bytes]):
        step: dict[int, int] = {}
        final = [False]
        for piece in [*pieces, *(bytes([b]) for b in range(256))]:
            state = 0
            for b in piece:
                key = state << 8 | b
                state = step.get(key)
                if state is None:
                    state = step[key] = len(final)
                    final.append(False)
            final[state] = True
        children: list[list[tuple[int, int]]] = [[] for _ in final]
        for key, state in step.items():
            children[key >> 8].append((key & 255, state))
        fail, popped = [0] * len(final), [0] * len(final)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for b, state in children[parent]:
                if final[state]:
                    popped[state] = 1
                else:
                    count, link = popped[parent], fail[parent]
                    while link << 8 | b not in step:
                        count += popped[link]
                        link = fail[link]
                    popped[state], fail[state] = count, step[link << 8 | b]
                queue.append(state)
        self.step, self.fail, self.popped = step, fail, popped

    def count(self, word: bytes) -> int:
        step, fail, popped = self.step, self.fail, self.popped
        state = total = 0
        for b in word:
            after = step.get(state << 8 | b)
            while after is None:
                total += popped[state]
                state = fail[state]
                after = step.get(state << 8 | b)
            state = after
        while state:
            total += popped[state]
            state = fail[state]
        return total


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        value = self.automaton.count(b" " + word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


def count_tokens(docs: DataFrame, pieces: Iterable[bytes] | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_words, n_tokens`` for every row of ``docs(doc_id, text)``.

    The UTF-8 text is cut ahead of every space; each cut piece, with its space, is split
    greedily into the longest vocabulary pieces. ``n_words`` counts cut pieces with more than
    a space. Null and empty texts count 0; repeated rows are all kept; other columns are
    ignored; an empty table gives no rows. Needs no shuffle and holds one text at a time.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_words", pa.int64()),
                        ("n_tokens", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(
        Automaton(read_vocabulary() if pieces is None else pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        counts = _Counts(automaton)
        out = []
        for doc_id, text in rows_in(batches, "doc_id", "text"):
            data = text.encode()
            first, *rest = data.split(b" ")
            tokens = automaton.count(first) + sum(map(counts.__getitem__, rest))
            words = len(rest) + 1 - rest.count(b"") - (not first)
            out.append((doc_id, len(data), words, tokens))
            if len(out) >= 8_192:
                yield batch_of(schema, *zip(*out))
                out = []
        if out:
            yield batch_of(schema, *zip(*out))

    return texts(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_words bigint, n_tokens bigint")
