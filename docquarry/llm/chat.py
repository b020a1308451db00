"""Chat formatting: every assistant turn becomes an example of its own.

An example is the formatted text of all turns up to and including one assistant turn, and
only that reply is trainable. Examples of one conversation are prefixes of one another, so
an example can be kept as the part it adds, which is linear in the input also for conversations
of any number of turns. ``full_examples`` makes every example with all that precedes its reply;
``render`` does so from parts in any order.

Template: ``[INST] text [/INST]`` for a user, ``text </s>`` for an assistant,
``[ROLE] name [TEXT] text [/TEXT]`` for any other role, each followed by a line feed. Inside
texts a control string is escaped by a backslash, and backslashes ahead of it are doubled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import batch_of, rows_in

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/TEXT]"]
_CONTROL = "|".join(re.escape(c) for c in CONTROLS)
_ESCAPE = re.compile(rf"(\\*)({_CONTROL})")
_ESCAPED = re.compile(rf"(\\+)({_CONTROL})")
_TURN = re.compile(
    rf"\[INST\] (?P<user>.*?) (?<!\\)\[/INST\]\n"
    rf"|\[ROLE\] (?P<role>.*?) (?<!\\)\[TEXT\] (?P<other>.*?) (?<!\\)\[/TEXT\]\n"
    rf"|<s> (?P<assistant>.*?) (?<!\\)</s>\n", re.S,
)
_EXAMPLES = pa.schema([
    ("conv_id", pa.int64()), ("example", pa.int64()), ("target_turn", pa.int64()),
    ("part", pa.string()), ("prefix_chars", pa.int64()), ("loss_start", pa.int64()),
    ("loss_end", pa.int64()),
])
_FULL = pa.schema([
    ("conv_id", pa.int64()), ("example", pa.int64()), ("target_turn", pa.int64()),
    ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()),
])
FULL_EXAMPLES = "conv_id bigint, example bigint, target_turn bigint, text string, loss_start bigint, loss_end bigint"
EXAMPLES = ("conv_id bigint, example bigint, target_turn bigint, part string, "
            "prefix_chars bigint, loss_start bigint, loss_end bigint")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its text stands in it."""
    body = escape(text)
    if role == "user":
        head, tail = "[INST] ", " [/INST]\n"
    elif role == "assistant":
        head, tail = "<s> ", " </s>\n"
    else:
        head, tail = f"[ROLE] {escape(role)} [TEXT] ", " [/TEXT]\n"
    return head + body + tail, len(head), len(head) + len(body)


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn of a formatted text."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        if m["user"] is not None:
            yield "user", unescape(m["user"])
        elif m["assistant"] is not None:
            yield "assistant", unescape(m["assistant"])
        else:
            yield unescape(m["role"]), unescape(m["other"])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = object()
    current, out, out_chars = none, [], 0
    example = before = length = 0
    parts: list[str] = []

    def close(target, start, end):
        nonlocal example, before, length, parts, out_chars
        out.append((current, example, target, "".join(parts), before, start, end))
        out_chars += length
        example, before, length, parts = example + 1, before + length, 0, []

    for conv, turn, role, text in rows_in(batches, "conv_id", "turn", "role", "text"):
        if conv != current or current is none:
            if parts:
                close(None, None, None)
            current, example, before, length, parts = conv, 0, 0, 0, []
        piece, start, end = format_turn(role, text)
        parts.append(piece)
        at = before + length
        length += len(piece)
        if role == "assistant":
            close(turn, at + start, at + end)
        if out_chars > 4_000_000 or len(out) >= 5_000:
            yield batch_of(_EXAMPLES, *zip(*out))
            out, out_chars = [], 0
    if parts:
        close(None, None, None)
    if out:
        yield batch_of(_EXAMPLES, *zip(*out))


def prefix_examples(turns: DataFrame) -> DataFrame:
    """Examples of all conversations ``(conv_id, turn, role, text)``.

    One row per assistant turn, plus one row without a target for turns after the last one.
    ``part`` is what the example adds to the text of the example before; ``prefix_chars``
    counts the characters ahead of it; ``loss_start`` and ``loss_end`` bound the escaped reply
    in the example's full text. Rows of a conversation are sorted by turn (null first), then
    role, then text; repeated rows are all kept. Null role or text counts as empty, and rows
    without ``conv_id`` form one conversation. An empty table gives no rows. Other columns are
    ignored. A conversation is streamed, never held: its turns go to one task in order.
    """
    narrow = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_expand, EXAMPLES)


def render(examples: DataFrame) -> DataFrame:
    """Full texts: ``(conv_id, example, target_turn, text, loss_start, loss_end)``.

    Writing prefixes out grows with the square of a conversation's turns; the parts do not.
    """
    so_far = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, 0)
    return examples.withColumn("text", F.concat_ws("", F.collect_list("part").over(so_far))).where(
        "loss_start is not null"
    ).select("conv_id", "example", "target_turn", "text", "loss_start", "loss_end")


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, out_chars, text = [], 0, ""
    for conv, example, target, part, start, end in rows_in(
            batches, "conv_id", "example", "target_turn", "part", "loss_start", "loss_end"):
        text = part if example == 0 else text + part
        out.append((conv, example, target, text, start, end))
        out_chars += len(text)
        if out_chars > 4_000_000 or len(out) >= 5_000:
            yield batch_of(_FULL, *zip(*out))
            out, out_chars = [], 0
    if out:
        yield batch_of(_FULL, *zip(*out))


def full_examples(examples: DataFrame) -> DataFrame:
    """Every example of ``prefix_examples`` with its whole text: ``(conv_id, example, target_turn, text, loss_start, loss_end)``.

    Also the one without a target. Reads the rows in the order in which ``prefix_examples`` makes them, and holds one text at a
    time; the rows of a conversation take the square of its turns.
    """
    return examples.mapInArrow(_full, FULL_EXAMPLES)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
        ("n_examples", pa.int64()),
    ])
    out, current, last, state = [], None, "", None

    def close() -> None:
        turns, n_turns = sha256(), 0
        for role, text in parse_turns(last):
            n_turns += 1
            turns.update(f"{role}\n{text}\n".encode())
        out.append((current, n_turns, turns.hexdigest(), state[0], state[1].hexdigest(), len(last), state[2]))

    for conv, example, text, start, end in rows_in(batches, "conv_id", "example", "text", "loss_start", "loss_end"):
        if state is None or example == 0:
            if state is not None:
                close()
            current, last, state = conv, "", [0, sha256(), 0]
        if not text.startswith(last):
            raise ValueError(f"example {example} does not continue the one before")
        last = text
        if start is not None:
            reply = unescape(text[start:end])
            state[0] += len(reply)
            state[1].update(reply.encode())
            state[2] += 1
        if len(out) >= 5_000:
            yield batch_of(schema, *zip(*out))
            out.clear()
    if state is not None:
        close()
    if out:
        yield batch_of(schema, *zip(*out))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """What the ``full_examples`` of the output of ``prefix_examples`` hold, read back by the template alone.

    Replies are read from the whole text of their example, turns from the last example of a conversation, which all others begin.
    """
    return full_examples(examples).mapInArrow(
        _digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint, n_examples bigint")
