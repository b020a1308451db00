"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is a Boolean expression that is true where a text is rejected. On a bounded sample of the
rows the time of each rule is measured, and which rules reject which rows; the rules are then ordered
greedily by what they reject, of the rows the earlier ones left, per second. Over all rows they become one
``CASE WHEN`` in that order, of which Spark evaluates no branch after the first that holds. The verdict
does not depend on the order: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import let
from docquarry.session import scope, stage

SAMPLE_ROWS = 2_000
#: Rules are timed as often as this; less than so many seconds over a rule that does nothing count as that.
RUNS, RESOLUTION = 3, 0.01
WINDOW = 5
LEAST_WORDS = 10
BLANK = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: Insults; a text that holds one as a word is rejected. A parameter of ``default_rules``.
INSULTS = ("idiot", "imbecile", "moron", "scumbag", "worthless", "clown", "loser", "dumbass")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true where a row is rejected; null counts as not rejected."""

    name: str
    rejects: Column


def word_list(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), lambda w: w != "")


def line_list(text: Column) -> Column:
    """``\\n``-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(f"[^{BLANK}]"))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words which the list holds twice or more, each counted once.

    Windows are told apart by two 64-bit hashes. A list whose windows all differ, the usual case, is
    settled by one distinct count; else windows are sorted with their places, which costs n log n, so very
    long texts are no worse than many short ones.
    """
    def hashed(ws):
        names = let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - window),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])))
        return F.when(F.size(ws) >= window, names).otherwise(F.array().cast("array<bigint>"))

    def second(ws, i):
        return F.hash(*[F.get(ws, i + k) for k in range(window)])

    def placed(ws, names):
        rows = F.array_sort(F.transform(names, lambda name, i: F.struct(
            name.alias("a"), second(ws, i).alias("b"), i.alias("i"))))

        def twice(sorted_rows):
            def same(row, other):
                return (row["a"] == other["a"]) & (row["b"] == other["b"])
            kept = F.filter(sorted_rows, lambda row, k: F.coalesce(same(row, F.get(sorted_rows, k + 1)), F.lit(False))
                            | F.coalesce(same(row, F.get(sorted_rows, k - 1)), F.lit(False)))
            return F.array_sort(F.transform(kept, lambda row: row["i"]))

        return let(let(rows, twice), lambda places: F.aggregate(
            F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window)))),
            F.lit(0).cast("bigint"), lambda total, n: total + n))

    return let(words, lambda ws: let(hashed(ws), lambda names: F.when(
        F.size(F.array_distinct(names)) == F.size(names), F.lit(0).cast("bigint")).otherwise(placed(ws, names))))


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs(text, ...)`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    Null text counts as empty: no words, which fails the base. Columns of these names are replaced, and so are ``_words``
    and ``_lines``, which hold the words and lines for the rules.
    """
    split = docs.withColumns({"_words": word_list(F.col("text")), "_lines": line_list(F.col("text"))})
    counted = split.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.coalesce(F.regexp_count("text", F.lit(f"[{SYMBOLS}]")), F.lit(0)).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": repeated_words(F.col("_words")),
    })
    return counted.withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def default_rules(insults: tuple[str, ...] = INSULTS) -> list[Rule]:
    """Rules over the columns of ``with_counts``; every limit is a comparison of integers."""
    words, n, n_lines = F.col("_words"), F.col("n_words"), F.size("_lines").cast("bigint")

    def count(holds) -> Column:
        return F.size(F.filter(words, holds)).cast("bigint")

    return [
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 12 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * n_lines),
        Rule("letterless_words", 5 * count(lambda w: w.rlike(r"\p{L}")) < 4 * n),
        Rule("shouting", 10 * count(lambda w: w.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")) > 3 * n),
        Rule("ellipses", 10 * F.size(F.filter("_lines", lambda l: l.rlike(r"(\.\.\.|…)\s*$"))).cast("bigint") > 3 * n_lines),
        Rule("insults", F.arrays_overlap(
            F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}]", ""))),
            F.array(*[F.lit(w) for w in insults])) if insults else F.lit(False)),
    ]


def _seconds(run: Callable[[], object]) -> float:
    """The shortest of some runs, after one that compiles."""
    run()
    taken = []
    for _ in range(RUNS):
        start = time.perf_counter()
        run()
        taken.append(time.perf_counter() - start)
    return min(taken)


def measure(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """``(name, rejected share, seconds a row)`` of the rules in the order in which they should run.

    The sample is drawn by chance from all rows and holds about ``sample_rows`` of them, so what comes to the driver
    is bounded: the patterns of rejection that its rows show. Rows that fail the base take no part.
    """
    with scope(docs.sparkSession):
        share = min(1.0, sample_rows / max(docs.count(), 1))
        sample = stage(with_counts(docs.sample(share, seed=0)).where(~F.col("base_failed")), "sample")
        size = sample.count()
        seconds = {}
        for rule in [Rule("", F.lit(False)), *rules]:
            seconds[rule.name] = _seconds(sample.agg(F.count_if(rule.rejects)).first)
        bits = [F.coalesce(r.rejects, F.lit(False)).cast("int").alias(r.name) for r in rules]
        patterns = sample.select(*bits).groupBy(*[r.name for r in rules]).count().collect()
    left, order, open_rules = [(p, p["count"]) for p in patterns], [], [r.name for r in rules]
    base = seconds.pop("")
    cost = {name: max(s - base, RESOLUTION) / max(size, 1) for name, s in seconds.items()}
    while open_rules:
        hits = {name: sum(n for p, n in left if p[name]) for name in open_rules}
        best = max(open_rules, key=lambda name: (hits[name] / cost[name], -cost[name]))
        order.append((best, hits[best] / max(sum(n for _, n in left), 1), cost[best]))
        left = [(p, n) for p, n in left if not p[best]]
        open_rules.remove(best)
    return order


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects a row, in the order given; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All rows and columns of ``docs(text, ...)`` with the counts of ``with_counts``, ``rejected_by`` and ``kept``.

    A row that fails the base (fewer than ten words, or over a fifth of them in repeated windows) is
    rejected as ``base`` and enters no rule. ``rejected_by`` is the first rule of the measured order that rejects the
    row; where several do, it may differ from run to run, ``kept`` does not. Null and empty texts fail the base; repeated rows
    are judged one by one; an empty table gives no rows; columns named like the new ones are replaced.
    """
    rules = default_rules() if rules is None else rules
    by_name = {rule.name: rule for rule in rules}
    counted = with_counts(docs)
    order = measure(docs, rules, sample_rows) if rules else []
    first = cascade([by_name[name] for name, _, _ in order])
    judged = counted.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(first))
    return judged.withColumn("kept", F.col("rejected_by").isNull()).drop("_words", "_lines")
