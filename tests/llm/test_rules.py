"""The rule cascade against plain counting, and its order."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docquarry.llm import rules

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def plain(text):
    words = re.findall(f"[^{BLANK}]+", text or "")
    lines = [x for x in (text or "").split("\n") if x.strip(BLANK)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


def texts():
    random.seed(7)
    made = [" ".join(random.choices("a b c dd é 日本 | # x.".split(), k=n)) for n in range(0, 60, 3)]
    plainly = "Plain words that differ from one another all along this quite ordinary line of text"
    return [None, "", " \t\n", "one", "   x", plainly, "\n".join([plainly] * 3), *made,
            "\n".join(random.choices(["a b", "c\td", "", " ", "\r", "e"], k=40)),
            "same same same same same same same same same same same", plainly.upper(), plainly + " you Moron!",
            " ".join(f"w{i % 700}" for i in range(30_000)), plainly, "\U0001F600 " * 12]


def test_counts_equal_plain_counting(docs):
    found = rules.judge(docs(list(enumerate(texts())))).collect()
    assert len(found) == len(texts())
    for r in found:
        text = texts()[r.doc_id]
        if text and len(text) > 10_000:
            assert (r.n_words, r.n_repeat_words, r.base_failed) == (30_000, 30_000, True)
            continue
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(text)
    by_text = {texts()[r.doc_id]: (r.kept, r.rejected_by) for r in found}
    plainly = texts()[5]
    assert by_text[plainly] == (True, None)
    assert by_text[plainly.upper()] == (False, "shouting")
    assert by_text[plainly + " you Moron!"] == (False, "insults")
    assert by_text[None] == by_text[""] == (False, "base")


def test_order_follows_rejection_per_cost(docs, monkeypatch):
    plainly = "some words that make up a line which fails no base rule at all number"
    table = docs([(i, f"{plainly} {i}") for i in range(400)])
    digit = F.regexp_extract("text", r"(\d+)$", 1).cast("int") % 10
    made = [rules.Rule("rare", digit == 0), rules.Rule("never", digit > 10), rules.Rule("slow", digit < 8),
            rules.Rule("often", digit < 7), rules.Rule("dear", digit == 9), rules.Rule("null", F.lit(None).cast("boolean"))]
    taken = iter([0.1, 0.2, 0.1, 5.0, 0.2, 0.3, 0.1])  # of a rule that does nothing, then of these
    monkeypatch.setattr(rules, "_seconds", lambda run: (run(), next(taken))[1])
    order = rules.measure(table, made)
    # Of what "often" leaves, "rare" rejects nothing more.
    assert [name for name, _, _ in order][:3] == ["often", "dear", "slow"]
    assert [round(share, 6) for _, share, _ in order] == [0.7, round(40 / 120, 6), 0.5, 0, 0, 0]
    monkeypatch.undo()
    judged = rules.judge(table, made)
    assert judged.where("kept").count() == 40
    assert rules.judge(table, []).where("kept").count() == 400


def test_costly_rules_are_measured_as_such(docs):
    table = docs([(i, "some words that make up a line which fails no base rule at all number") for i in range(2000)])
    slow = F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: i + F.length("text")))) > 0
    order = rules.measure(table, [rules.Rule("slow", slow), rules.Rule("quick", F.length("text") > 3)])
    assert [name for name, _, _ in order] == ["quick", "slow"] and order[1][2] > 3 * order[0][2]


def test_later_rules_are_not_evaluated(docs):
    table = docs([(i, "x") for i in range(10)])
    boom = F.raise_error(F.lit("evaluated")).cast("boolean")
    first = rules.cascade([rules.Rule("all", F.col("doc_id") >= 0), rules.Rule("boom", boom)])
    assert {r.r for r in table.select(first.alias("r")).collect()} == {"all"}
    with pytest.raises(Exception, match="evaluated"):
        table.select(rules.cascade([rules.Rule("boom", boom)])).collect()


def test_odd_tables(spark, docs):
    assert rules.judge(docs([])).count() == 0
    clash = docs([(1, "x " * 12), (1, "x " * 12)]).withColumn("n_words", F.lit("own")).withColumn("kept", F.lit(7)).withColumn(
        "_words", F.lit(1)).withColumn("1", F.lit(2))
    assert [(r.n_words, r.kept, r["1"]) for r in rules.judge(clash).collect()] == [(12, False, 2)] * 2


def test_no_python_in_the_plan(docs):
    plan = rules.judge(docs([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
