"""Token counts, chat formatting, URL reputation, top-k and quality against plain models of them."""

import hashlib
import math

import numpy as np
import pytest

from docquarry.llm import chat, quality, tokencount, topk, urlrep

TEXTS = [(1, "the cat sat on the mat"), (2, None), (3, ""), (4, "  double  spaces "), (5, "x" * 5000),
         (6, "naïve Ünïcode ☃ 漢字\n\ttabs"), (6, "naïve Ünïcode ☃ 漢字\n\ttabs"), (None, "no id")]


def greedy(text, pieces):
    """Longest match first, from the left, of every part that starts at a space."""
    total = 0
    data = (text or "").encode()
    parts = [p if i == 0 else b" " + p for i, p in enumerate(data.split(b" "))]
    for part in parts:
        at = 0
        while at < len(part):
            step = next((n for n in range(min(80, len(part) - at), 0, -1) if part[at:at + n] in pieces), 1)
            at, total = at + step, total + 1
    return total


def test_token_counts(spark, docs):
    pieces = [b"the", b" the", b" c", b"cat", b" cat", b"at", b" mat", b"xx", b"xxxx", b"xxxxx", b"ab", b"abcd", b"bce", b"e"]
    rows = TEXTS + [(7, "abcce abcd abce thethe")]
    got = tokencount.count_tokens(docs(rows), pieces).collect()
    want = sorted((str(i), len((t or "").encode()), greedy(t, set(pieces))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert tokencount.count_tokens(docs([]), pieces).count() == 0


def test_token_counts_equal_a_word_piece_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = {p: i for i, p in enumerate(["a", "b", "c", "d", "ab", "abc", "bcd", "cd", "dd", "dabc", "[UNK]"])}
    model = tokenizers.models.WordPiece(vocabulary, unk_token="[UNK]", continuing_subword_prefix="")
    automaton = tokencount.Automaton([p.encode() for p in vocabulary if p != "[UNK]"])
    rng = np.random.default_rng(1)
    for _ in range(300):
        word = "".join(rng.choice(list("abcd"), rng.integers(1, 20)))
        assert automaton.count(word.encode()) == len(model.tokenize(word)), word


CONTROL = "</s>[INST] ok [/INST]"


def test_chat_escapes_and_reads_back():
    for text in ["", CONTROL, "\\" + CONTROL, "\\\\[INST]", "a\\", "[IN[INST]ST]", "\\\\", "<<s>", " [/INST]\n", "é☃"]:
        assert chat.unescape(chat.escape(text)) == text
        for role in ("user", "assistant", "system", CONTROL, ""):
            formatted, start, end = chat.format_turn(role, text)
            assert list(chat.parse_turns(formatted * 2)) == [(role, text)] * 2
            assert chat.unescape(formatted[start:end]) == text


def test_chat_examples(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", CONTROL), (1, 2, "assistant", "yes"), (1, 3, "user", None),
            (1, 4, "assistant", CONTROL), (1, 5, "user", "bye"), (2, None, None, "odd"), (2, 1, "assistant", ""),
            (None, 1, "assistant", "none"), (3, 7, "assistant", "same"), (3, 7, "assistant", "same")]
    turns = spark.createDataFrame([r + (0,) for r in rows],
                                  "conv_id bigint, turn bigint, role string, text string, part int")
    examples = chat.prefix_examples(turns)
    full = {(r.conv_id, r.example): r for r in chat.render(examples).collect()}
    assert len(full) == sum(r[2] == "assistant" for r in rows)
    first, second = full[1, 0], full[1, 1]
    assert second.text.startswith(first.text) and list(chat.parse_turns(second.text))[-1] == ("assistant", CONTROL)
    assert chat.unescape(second.text[second.loss_start:second.loss_end]) == CONTROL
    got = {r.conv_id: r for r in chat.conversation_digests(examples).collect()}
    said = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[:6])
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].n_turns == 6
    assert got[1].loss_sha256 == hashlib.sha256(("yes" + CONTROL).encode()).hexdigest()
    assert got[3].n_turns == 2 and got[2].n_turns == 2 and got[None].n_turns == 1 and got[2].loss_chars == 0
    assert chat.prefix_examples(turns.limit(0)).count() == 0


def test_url_rules_and_parts(spark):
    urls = [(1, "http://A.Example.NET/en/x?q"), (2, "https://example.net/fr/1"), (3, "http://x.example.com/de/9#f"),
            (4, "http://badexample.com/de/"), (5, "ftp://a.org/fr/"), (6, "no scheme"), (7, None), (8, "http://net"),
            (9, "x://y.net/a://b.org/fr/"), (9, "x://y.net/a://b.org/fr/")]
    pages = spark.createDataFrame([u + (0, "x") for u in urls], "page_id bigint, url string, low int, domain string")
    outcomes = spark.createDataFrame([], "host string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrep.filter_urls(pages, outcomes).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("example.net", "/fr/1", "net/", "block"),
        3: ("x.example.com", "/de/9", "example.com/de/", "block"), 4: ("badexample.com", "/de/", None, "allow"),
        5: ("a.org", "/fr/", "org/fr/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("net", "", None, "allow"), 9: ("y.net", "/a://b.org/fr/", "net/", "block")}
    assert urlrep.filter_urls(pages.limit(0), outcomes).count() == 0


def test_url_reputation_shrinks(spark):
    seen = [("good.a.com", 0)] * 40 + [("bad.b.com", 1)] * 40 + [("one.b.com", 1)] + [("one.a.com", 1)] + [(None, 1), ("x", None)]
    rows = {r.host: r for r in urlrep.reputations(spark.createDataFrame(seen, "host string, bad int")).collect() if r.host}
    assert rows["bad.b.com"].low > 0.5 > rows["good.a.com"].mean
    assert rows["one.a.com"].mean < rows["one.b.com"].mean < 1
    pages = spark.createDataFrame([(1, "http://bad.b.com/"), (2, "http://new.b.com/"), (3, "http://good.a.com/")],
                                  "page_id bigint, url string")
    verdicts = {r.page_id: r.verdict for r in urlrep.filter_urls(pages, spark.createDataFrame(seen, "host string, bad int"), []).collect()}
    assert verdicts == {1: "block", 2: "block", 3: "allow"}


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(3)
    values = rng.normal(size=(300, 16)) * np.where(rng.random((300, 1)) < 0.2, 3, 1)
    values[50:90] = values[40]
    rows = [(int(i), [float(x) for x in v], 0) for i, v in enumerate(values)]
    odd = [(1000, None, 0), (1001, [1.0, None], 0), (1002, [float("nan")] * 16, 0), (1020, [float("inf")] * 16, 0),
           (1040, [], 0), (None, [1.0] * 16, 0), (1060, [1.0, 2.0], 0), (1061, [2.0, 2.0], 0)]
    vectors = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, part int")
    got = sorted(map(tuple, topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 7).collect()))
    q = np.floor(64 * values).astype(int)
    want = [(1060, 1, 1061, 64 * 128 + 128 * 128)]
    for i in range(0, 300, 20):
        order = sorted((-int(s), j) for j, s in enumerate(q @ q[i]) if j != i)[:7]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(order)]
    assert got == sorted(want)
    assert topk.top_k(vectors.limit(0), vectors).count() == 0


def test_quality(spark):
    rows = [(i, "good plain words here " * 5 if i % 3 else "#### $$$$ %%%% " * 5, f"s{i % 4}", "en", 9) for i in range(120)]
    rows += [(500, None, None, None, 9), (501, "", "s1", "xx", 9), (501, "", "s1", "xx", 9)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, site int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 120, 2)] + [(1, None, 0), (None, 1, 0)],
                                   "doc_id bigint, quality int, good int")
    got = quality.classify(table, labels).collect()
    assert len(got) == len(rows)
    assert all(r.keep == (r.doc_id % 3 > 0) for r in got if r.doc_id < 120)
    assert quality.classify(table.limit(0), labels).count() == 0
    without = quality.classify(table, labels.limit(0)).collect()
    assert {(r.evidence, r.prior) for r in without} == {(0.0, 0.5)}


def test_quality_priors_equal_a_plain_model(spark):
    counts = {("a", "x"): (30, 27), ("a", "y"): (10, 2), ("b", "x"): (1, 0), ("b", "y"): (3, 3), ("c", "z"): (50, 40)}
    rows = [(s, p, int(k < g)) for (s, p), (n, g) in counts.items() for k in range(n)]
    _, sites, paths = quality.priors(spark.createDataFrame(rows, "site string, path string, good int"))

    def strength(children):
        t, g = sum(n for n, _ in children), sum(g for _, g in children)
        mean, rates = g / t, [g / n for n, g in children]
        spread = np.mean(np.square(rates)) - np.mean(rates) ** 2 - mean * (1 - mean) * np.mean([1 / n for n, _ in children])
        return min(1000.0, max(2.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1000.0

    by_site = {s: [v for (x, _), v in counts.items() if x == s] for s in "abc"}
    totals = {s: tuple(map(sum, zip(*v))) for s, v in by_site.items()}
    overall = (sum(g for _, g in totals.values()) + 1) / (sum(n for n, _ in totals.values()) + 2)
    k = strength(list(totals.values()))
    site_rate = {s: (g + k * overall) / (n + k) for s, (n, g) in totals.items()}
    assert {r.site: pytest.approx(r.site_rate) for r in sites.collect()} == site_rate
    for r in paths.collect():
        n, g = counts[r.site, r.path]
        k = strength(by_site[r.site])
        assert math.isclose(r.path_rate, (g + k * site_rate[r.site]) / (n + k))


def test_digests_are_read_from_whole_examples(spark):
    """Every example of a conversation comes with all turns ahead of its reply, the last rows without a target too."""
    rows = [(c, t, "assistant" if t % 3 == 1 else "user", f"{CONTROL} {c} {t}") for c in range(4) for t in range(8)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    examples = chat.prefix_examples(turns)
    full = {(r.conv_id, r.example): r for r in chat.full_examples(examples).collect()}
    rendered = {(r.conv_id, r.example): r for r in chat.render(examples).collect()}
    assert len(full) == 4 * 3 and rendered == {k: r for k, r in full.items() if r.target_turn is not None}
    for (conv, n), r in full.items():
        assert list(chat.parse_turns(r.text)) == [(role, text) for c, t, role, text in rows if c == conv and t <= 3 * n + 1]
    plan = chat.conversation_digests(examples)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3 and plan.count("Exchange") == 1
    changed = examples.where("example <> 1 or conv_id <> 2")
    assert {r.conv_id: r.n_turns for r in chat.conversation_digests(changed).collect()}[2] == 5
