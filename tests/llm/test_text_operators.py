"""Language, decontamination, repeats, near copies and pieces against brute force."""

import collections
import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import anchors, common, components, decontam, jaccard, langid, pieces, repeats, rows

RNG = np.random.default_rng(5)
VOCABULARY = [f"{a}{b}{c}" for a in "bdkmt" for b in ("a", "eu", "ó") for c in ("n", "st", "ll", "")]


def words(n, rng=RNG):
    return list(rng.choice(VOCABULARY, n))


def changed(text, *places):
    out = list(text)
    for p in places:
        out[p % len(out)] = "changed"
    return out


def corpus():
    """Copies, near copies, shared passages, a very long word, blanks, nulls and repeated rows."""
    base, other, passage = words(200), words(120), words(130)
    texts = [base, base, changed(base, 50), changed(base, 50, 120), changed(base, 3, 60, 110, 160), other,
             other[:60] + passage + other[60:], words(80) + passage, passage + words(40) + passage, words(3), words(3),
             ["one"], ["One"], words(5), ["a"] * 900, ["ab"] * 300]
    out = [(i, " ".join(t)) for i, t in enumerate(texts)]
    out += [(100, None), (101, ""), (102, " \n\t "), (103, "x" * 3000), (104, "y" + "x" * 1500), (7, out[7][1]),
            (105, "THE " + " ".join(base[1:])), (None, " ".join(words(30))), (106, "é☃" * 400), (107, "☃é" * 200)]
    return out


CORPUS = corpus()


def shingles(text):
    w = (text or "").encode().translate(jaccard.LOWER).split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(table):
    sets = [shingles(t) for _, t in table]
    parent = list(range(len(table)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    members = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(table):
        members[root(i)].append(doc_id)
    least = {r: min((d for d in m if d is not None), default=None) for r, m in members.items()}
    return [(d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(table)]


def by_text(rows_):
    return sorted(rows_, key=str)


def test_near_copies(docs):
    got = [tuple(r) for r in jaccard.similar_groups(docs(CORPUS)).collect()]
    assert by_text(got) == by_text(brute_groups(CORPUS))


def test_near_copies_of_nothing(docs):
    assert jaccard.similar_groups(docs([])).count() == 0
    got = jaccard.similar_groups(docs([(1, None), (2, ""), (3, "a b"), (4, "A B")])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3)]


def test_prefixes_admit_every_similar_pair():
    """Whatever level each set takes, a similar pair shares what is asked of it."""
    rng = np.random.default_rng(11)
    for _ in range(400):
        n = int(rng.integers(1, 60))
        x = rng.choice(10_000, n, replace=False)
        y = np.unique(np.concatenate([rng.choice(x, int(rng.integers(max(1, int(.8 * n)), n + 1)), replace=False),
                                      rng.choice(10_000, int(rng.integers(0, 8)))]))
        x = np.unique(x)
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both):
            continue
        sides = []
        for s in (x, y):
            level, length = jaccard.choose_level(rng.integers(0, 50, len(s)), len(s))
            sides.append((set(s[:length].tolist()), level, len(s)))
        o = -(-80 * (len(x) + len(y)) // 180)
        least = min(level + o - -(-80 * n // 100) for _, level, n in sides)
        assert len(sides[0][0] & sides[1][0]) >= least


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (5, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_repeats(table, length=400):
    raw = [(t or "").encode() for _, t in table]
    seen = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (doc_id, _), b in zip(table, raw):
        gone = np.zeros(len(b) + 2, dtype=int)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i + 1:i + length + 1] = 1
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        out.append((doc_id, int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_anchors_depend_on_their_surroundings_only():
    data = RNG.integers(97, 103, 9000).astype(np.uint8)
    whole = anchors.anchors(data)
    part = anchors.anchors(data[1000:5000]) + 1000
    inner = lambda a: a[(a >= 1000 + anchors.WINDOW) & (a < 5000 - anchors.WINDOW - anchors.GRAM)]
    assert np.array_equal(inner(whole), inner(part)) and np.diff(whole).max() <= anchors.WINDOW


def test_repeats(docs):
    edge = words(90)
    table = CORPUS + [(200 + i, " ".join(words(i) + edge[: 60 + i] + words(9 - i))) for i in range(10)]
    got = repeats.without_repeats(docs(table))
    assert set(got.columns) == {"doc_id", "text", "token", "sid", "block", "text_key", "kept", "n_removed", "n_spans"}
    found = [(r.doc_id, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.collect()]
    assert by_text(found) == by_text(brute_repeats(table))
    assert repeats.without_repeats(docs([])).count() == 0


def test_decontamination(docs, spark):
    item, short, long = words(30), words(6), words(300)
    replaced = changed(item, 5, 14, 22)
    benchmark = spark.createDataFrame(
        [(1, " ".join(item), 0), (2, " ".join(short), 0), (3, None, 0), (4, "", 0), (5, " ".join(long), 0), (5, " ".join(long), 0)],
        "item_id bigint, text string, doc_id int")
    table = [(1, " ".join(words(20) + item + words(20))), (2, " ".join(words(9) + replaced)), (3, " ".join(words(200))),
             (4, " ".join(item[:8] + words(40))), (5, " ".join(w.upper() + "," for w in item)), (6, None), (7, ""),
             (8, " ".join(words(30) + short)), (9, " ".join(long[100:120])), (10, " ".join(item)), (10, " ".join(item)),
             (None, " ".join(item)), (11, " ".join(words(5) + long[10:13] + words(50)))]
    got = decontam.overlaps(docs(table), benchmark).collect()
    assert sorted({r.doc_id for r in got if r.doc_id is not None}) == [1, 2, 5, 9, 10]
    assert all(r.overlap_words >= 13 for r in got) and {r.item_id for r in got if r.doc_id == 9} == {5}
    kept = decontam.without_contaminated(docs(table), benchmark).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4, 6, 7, 8, 11]
    assert decontam.overlaps(docs(table), benchmark.limit(0)).count() == 0
    assert decontam.without_contaminated(docs([]), benchmark).count() == 0


def test_decontamination_in_blocks(docs, spark, monkeypatch):
    items = [words(25) for _ in range(12)]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    table = docs([(i, " ".join(words(10) + w)) for i, w in enumerate(items)])
    whole = {(r.doc_id, r.item_id) for r in decontam.overlaps(table, benchmark).collect()}
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 60)
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(table, benchmark).collect()} == whole >= {(i, i) for i in range(12)}
    assert decontam.without_contaminated(table, benchmark).count() == 0


def brute_overlap(a, b):
    """Longest window of any diagonal, as length, matches and start in ``a``; the best of the longest."""
    best = (0, 0, 0)
    for shift in range(-len(b) + 1, len(a)):
        i, j = max(0, shift), max(0, -shift)
        same = [x == y for x, y in zip(a[i:], b[j:])]
        for s in range(len(same)):
            for e in range(s + 13, len(same) + 1):
                if 5 * sum(same[s:e]) >= 4 * (e - s):
                    best = max(best, (e - s, sum(same[s:e]), i + s))
    return best


def test_decontamination_equals_all_diagonals(docs, spark):
    """Substitutions near the ends, exact passages amid other words, several passages on one diagonal, few distinct words."""
    rng = np.random.default_rng(17)
    items = [words(int(n), rng) for n in (13, 13, 15, 16, 20, 40, 40)] + [["x", "y"] * 9, ["z"] * 14]
    table = [changed(items[0], 11), changed(items[1], 1, 11), changed(items[2], 2, 6, 10)]
    for item in items:
        for k in (0, 1, 2, 3, 4, 6):
            copy = changed(item, *(int(x) for x in rng.integers(0, len(item), k)))
            table.append(words(int(rng.integers(0, 9)), rng) + copy + words(int(rng.integers(0, 9)), rng))
    long = items[5]
    table += [words(6, rng) + long[8:28] + words(12, rng), words(4, rng) + long[:14] + words(9, rng) + long[23:] + words(3, rng),
              ["x", "y", "z"] * 8, ["z"] * 30, long[:11] + words(20, rng), words(3, rng) + long[4:14] + words(9, rng)]
    expected = {(i, j): found for i, t in enumerate(table) for j, item in enumerate(items)
                if (found := brute_overlap(t, item))[0]}
    benchmark = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id bigint, text string")
    table_ = docs([(i, " ".join(t)) for i, t in enumerate(table)])
    got = {(r.doc_id, r.item_id): (r.overlap_words, r.same_words, r.start_word)
           for r in decontam.overlaps(table_, benchmark).collect()}
    assert got == expected and {(0, 0), (1, 1), (2, 2)} <= set(got)
    kept = {r.doc_id for r in decontam.without_contaminated(table_, benchmark).collect()}
    assert kept == set(range(len(table))) - {i for i, _ in expected}


def test_masks_meet_every_overlap():
    """No choice of substituted places in a shortest overlap avoids all masks."""
    for n, substituted in ((13, 2), (15, 3), (20, 4), (25, 5)):
        places = np.array(list(itertools.combinations(range(n), substituted)))
        met = np.zeros(len(places), dtype=bool)
        for mask in decontam.MASKS:
            needed = np.array([c == "1" for c in mask])
            for at in range(n - len(mask) + 1):
                inside = (places >= at) & (places < at + len(mask))
                met |= ~(inside & needed[np.clip(places - at, 0, len(mask) - 1)]).any(axis=1)
        assert met.all()


def test_language(docs):
    kinds = {"aa": list("abcde"), "bb": list("vwxyz"), "cc": list("amnov")}
    rng = np.random.default_rng(2)

    def say(lang, n):
        return " ".join("".join(rng.choice(kinds[lang], rng.integers(2, 6))) for _ in range(n))

    table = [(i, say(lang, 30), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    table += [(500, None, "aa"), (501, "", "bb"), (502, "123 !? 4", "aa"), (503, say("aa", 20), None), (None, say("bb", 9), "bb"),
              (504, say("cc", 4000), "cc"), (0, table[0][1], "aa")]
    got = langid.identify(docs(table, ", lang string")).collect()
    assert len(got) == len(table)
    truth = {i: lang for i, _, lang in table if i is not None and i < 500}
    right = [truth[r.doc_id] == r.lang_pred for r in got if r.doc_id in truth]
    assert sum(right) >= 0.97 * len(right)
    fate = {r.doc_id: r for r in got}
    assert all(fate[i].lang_pred == "und" and not fate[i].accepted for i in (500, 501, 502))
    assert fate[503].lang_pred == "aa" and fate[504].lang_pred == "cc" and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(docs([], ", lang string")).count() == 0
    nothing = langid.identify(docs([(1, "abc", None)], ", lang string")).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]


def test_unlearned_language_is_rejected(docs):
    """A third of all rows in a language without labels, of all lengths; clean texts stay, short and rare lengths too."""
    kinds = {"aa": list("abcde"), "bb": list("vwxyz"), None: list("aeghi")}
    rng = np.random.default_rng(8)

    def say(lang, n):
        return " ".join("".join(rng.choice(kinds[lang], rng.integers(3, 7))) for _ in range(n))

    table = [(i, say(lang, int(rng.integers(6, 90))), lang) for i, lang in enumerate(["aa", "bb", None] * 120)]
    table += [(1000, say("aa", 3000), "aa"), (1001, say("bb", 2), "bb"), (1002, say(None, 3000), None)]
    fate = {r.doc_id: r.accepted for r in langid.identify(docs(table, ", lang string")).collect()}
    assert not [i for i, _, lang in table if lang is None and fate[i]]
    assert not [i for i, _, lang in table if lang and not fate[i]]


def test_kneser_ney_sums_to_one(spark):
    """Over every character that can follow, probabilities of a context add up to one."""
    table = spark.createDataFrame([("aa", "abba abab baab cab"), ("aa", "abc cab bac")], "lang string, text string")
    models = langid.Models(langid.train(table).toArrow())
    characters = list("abc ")
    missing = (1 << langid.CHAR_BITS) - len(characters)
    for context in ("  a", " ab", "abb", "zzz"):
        logs = []
        for c in [*characters, "q"]:
            run = np.array([sum(ord(x) << langid.CHAR_BITS * (3 - i) for i, x in enumerate(context + c))], dtype=np.uint64)
            total, done = 0.0, False
            for order in range(4, 0, -1):
                own = run & np.uint64((1 << langid.CHAR_BITS * order) - 1)
                value, found = models._look(0, order, own)
                if found[0]:
                    total, done = total + value[0], True
                    break
                value, found = models._look(0, -order, own >> np.uint64(langid.CHAR_BITS))
                total += value[0] if found[0] else 0.0
            logs.append(total if done else total - np.log(float(1 << langid.CHAR_BITS)))
        assert np.exp(logs[:-1]).sum() + missing * np.exp(logs[-1]) == pytest.approx(1.0, abs=0.01)


def test_unseen_runs_are_not_found(spark):
    """However full a model is, it knows only the runs it has seen."""
    rng = np.random.default_rng(3)
    text = " ".join("".join(map(chr, rng.integers(0x430, 0x460, 6))) for _ in range(3000))
    models = langid.Models(langid.train(spark.createDataFrame([("aa", text)], "lang string, text string")).toArrow())
    runs, _ = langid._runs(langid.pieces_of(text))
    others = np.setdiff1d(rng.integers(0, 1 << 60, 300_000).astype(np.uint64), runs)
    assert models._look(0, 4, runs)[1].all() and not models._look(0, 4, others)[1].any()


def test_language_in_passes(docs, monkeypatch):
    """Models too large for one pass, by entries or languages, give what one pass gives."""
    rng = np.random.default_rng(6)
    names = ["aa", "bb", "cc", None]
    table = [(i, " ".join("".join(rng.choice(list("abcdefg"[n:n + 4] + "漢😀"), 4)) for _ in range(12)), names[n])
             for i, n in enumerate(rng.integers(0, 4, 60).tolist())] + [(60, None, "aa"), (60, "", None), (None, "abc", "bb")]
    table_ = docs(table, ", lang string")

    def found():
        got = langid.cross_entropies(table_, table_).select("doc_id", "lang_pred", "n_predicted", "entropy").collect()
        return sorted(((str(r.doc_id), r.lang_pred, r.n_predicted, round(r.entropy or 0.0, 4)) for r in got))

    whole = found()
    monkeypatch.setattr(langid, "MODEL_ENTRIES", 400)
    assert found() == whole
    monkeypatch.setattr(langid, "MODEL_ENTRIES", 10_000_000)
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    assert found() == whole


TEXTS = [(1, "The cat sat on the mat."), (2, None), (3, ""), (4, "  two  spaces  "), (5, "naïve Ünïcode ☃ 漢字\n\ttabs 123.45²."),
         (6, "a" * 300 + " " + "xyz" * 90), (7, "▁ ▁▁x"), (8, " "), (9, "word"), (9, "word"), (None, "\x00 odd \U0001f600"),
         (10, "#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ a.b.c don't"), (11, "        deep"), (12, "Straße\r\nÉTÉ ñandú")]


def test_pieces_equal_the_library(docs):
    spm = pytest.importorskip("sentencepiece")
    library = spm.SentencePieceProcessor(model_file=pieces.MODEL)
    encoded = pieces.encode(docs(TEXTS))
    got = pieces.decode(encoded).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r.token_ids == library.encode(r.text or ""), r.text
        assert r.n_tokens == len(r.token_ids)
        assert r.decoded == (r.text or "").replace("▁", " ")
    assert pieces.encode(docs([])).count() == 0
    at_once = pieces.encode(docs(TEXTS), decoded=True)
    assert at_once.columns == pieces.decode(encoded).columns
    assert sorted(map(str, at_once.collect())) == sorted(map(str, got))


def test_pieces_by_viterbi(docs):
    spm = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=piece, score=0.0, type=kind)
    rng = np.random.default_rng(4)
    names = ["▁", *"abc", "ab", "bc", "▁a", "▁ab", "abc", "cab", "▁ca", "bca", "▁abca"]
    for piece in names:
        m.pieces.add(piece=piece, score=-float(rng.random() * 3 + 1.0 / len(piece)), type=1)
    m.trainer_spec.model_type, m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id = 1, 0, 1, 2
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = True, False
    m.normalizer_spec.escape_whitespaces = True
    library = spm.SentencePieceProcessor(model_proto=m.SerializeToString())
    model = pieces.Model([p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces], True, True)
    table = [(i, "".join(rng.choice(list("abc "), rng.integers(1, 30))).strip() or "a") for i in range(60)]
    table.append((99, "abc" * 40))
    for r in pieces.encode(docs(table), model).collect():
        assert r.token_ids == library.encode(r.text), r.text


def test_rows_by_id(docs, spark):
    table = docs([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (3, None)])
    gone = spark.createDataFrame([(2,), (9,), (None,)], "doc_id bigint")
    assert sorted(map(str, (r.doc_id for r in rows.without_ids(table, gone).collect()))) == ["1", "3", "None"]
    groups = spark.createDataFrame([(1, 5, 1), (2, 5, 2), (2, 5, 2), (3, 5, 1), (None, 5, 1)],
                                   "doc_id bigint, n_shingles bigint, component_id bigint")
    assert sorted(map(str, (r.doc_id for r in rows.one_per_group(table, groups).collect()))) == ["1", "2", "None"]


def test_runs_are_counted_in_bounded_memory(monkeypatch):
    """Words and runs that are held are bounded for all languages together, and every count is there in the end."""
    import pyarrow as pa

    from docquarry.llm import langid

    texts = [(f"l{i % 7}", " ".join(f"{chr(97 + i % 7)}{i}x{j}" for j in range(300))) for i in range(60)]
    batch = pa.RecordBatch.from_pydict({"lang": [lang for lang, _ in texts], "text": [text for _, text in texts]})

    def totals():
        found = {}
        for out in langid._count(iter([batch])):
            for lang, run, n in zip(*(out.column(c).to_pylist() for c in range(3))):
                found[lang, run] = found.get((lang, run), 0) + n
        return found

    sizes, runs = [], langid._runs
    monkeypatch.setattr(langid, "_runs", lambda words: sizes.append(len(words)) or runs(words))
    whole = totals()
    assert sum(sizes) == 60 * 300
    monkeypatch.setattr(langid, "COUNTED_WORDS", 1_000)
    monkeypatch.setattr(langid, "COUNTED_RUNS", 500)
    sizes.clear()
    assert totals() == whole and max(sizes) < 20_000 and len(sizes) > 7


def test_words_are_scored_some_at_a_time(monkeypatch):
    """However many words are new, the arrays made for their scores are bounded; scores do not change."""
    import numpy as np

    from docquarry.llm import langid

    class Lengths:
        languages, sizes = ["a", "b"], []

        def scores(self, words):
            self.sizes.append(len(words))
            return np.array([[-len(w), -2.0 * len(w)] for w in words], dtype=np.float32)

    docs = [[f"{'x' * (i % 5)}{i}-{j}" for j in range(50)] for i in range(40)]
    monkeypatch.setattr(langid, "SCORED_WORDS", 300, raising=False)
    models = Lengths()
    found = list(langid._Scorer(models).of(docs))
    assert max(models.sizes) <= 300 and sum(models.sizes) == 40 * 50
    for words, (sums, n) in zip(docs, found):
        chars = sum(map(len, words))
        assert sums.tolist() == [-chars, -2.0 * chars] and n == chars + len(words)


def test_words_that_are_units_are_not_cut_again():
    """A word that stands in the block's units as a whole takes its ids at once; ids and texts are the same as by cutting."""
    import pyarrow as pa

    from docquarry.llm import pieces

    model = pieces.read_model()
    cutter = pieces.Cutter(model)
    text = "plain words, and words of  two spaces é▁x"
    words = cutter.words("plain words and more") + cutter.words(text)
    units = sorted(cutter.units(set(words)))
    ids = [pieces.merge_long(u, model) for u in units]
    cut = []
    cutter.find, find = lambda word: cut.append(word) or find(word), cutter.find
    encoder = pieces._Encoder(model, cutter, pa.table({"unit": units, "ids": pa.array(ids, pa.list_(pa.int32()))}))
    plain = b"".join(map(encoder.__getitem__, cutter.words("plain words and more")))
    assert cut == []
    whole = b"".join(map(encoder.__getitem__, cutter.words(text)))
    assert len(cut) == 1
    lists = pa.array([memoryview(plain).cast("i").tolist(), None, [], memoryview(whole).cast("i").tolist()], pa.list_(pa.int32()))
    assert lists[0].as_py() == pieces.merge_long("▁plain▁words▁and▁more", model)
    assert pieces._Decoder(model).texts(lists) == ["plain words and more", None, "", text.replace("▁", " ")]


def test_packed_units_take_less_room_than_columns():
    import pyarrow as pa

    from docquarry.llm import pieces

    units = [f"▁é{i * 7919 % 100_003}x" for i in range(3_000)] + ["\n", "𝒳", "▁"]
    ids = [[i % 32_000, -i - 1, i % 7][: 1 + i % 3] for i in range(len(units))]
    table = pa.table({"unit": units, "ids": pa.array(ids, pa.list_(pa.int32()))}).slice(1)
    packed = pieces._units_packed(table)
    back = pieces._units_of(pa.scalar(packed))
    assert back.column("unit").to_pylist() == units[1:] and back.column("ids").to_pylist() == ids[1:]
    assert len(packed) < 0.9 * len(pieces._compressed(table))


def test_blocks_are_encoded_some_rows_at_a_time():
    """A block's texts leave in parts, also if its units and texts lie in several batches; a block without its texts is an error."""
    from types import SimpleNamespace

    import pyarrow as pa

    model = pieces.read_model()
    shared, cutter = SimpleNamespace(value=model), pieces.Cutter(model)
    texts = {1: [f"one text of number {i} é" for i in range(1_000)] + [None], 2: ["other words", ""]}
    rows = []
    for block, own in texts.items():
        units = sorted(cutter.units({w for t in own for w in cutter.words(t or "")}))
        for some in (units[::2], units[1::2]):
            ids = pa.array([pieces.merge_long(u, model) for u in some], pa.list_(pa.int32()))
            rows.append((block, pieces._units_packed(pa.table({"unit": some, "ids": ids})), None))
        table = pa.table({"doc_id": list(range(len(own))), "text": pa.array(own, pa.string())})
        rows.append((block, None, pieces._compressed(table)))
    schema = pa.schema([("block", pa.int64()), ("units", pa.binary()), ("rows", pa.binary())])

    def batches(rows, size):
        return iter([pieces.batch_of(schema, *zip(*rows[i:i + size])) for i in range(0, len(rows), size)])

    for size in (2, 10):
        out = list(pieces._encoded(shared, True)(batches(rows, size)))
        assert max(b.num_rows for b in out) <= 256
        got = [r for b in out for r in b.to_pylist()]
        assert [r["decoded"] for r in got] == [t or "" for own in texts.values() for t in own]
        assert got[5]["token_ids"] == pieces.merge_long("▁one▁text▁of▁number▁5▁é", model) and got[-1]["n_tokens"] == 0
    for missing in (2, 5):
        with pytest.raises(ValueError, match="block changed"):
            list(pieces._encoded(shared, True)(batches(rows[:missing] + rows[missing + 1:], 10)))


def test_sets_that_share_a_passage_only_are_not_paired(docs, spark, monkeypatch):
    """Texts that consist mostly of one passage make no rows of the last join unless they may be similar; no link is lost."""
    rng = np.random.default_rng(11)
    passage = words(160, rng)
    table = [(i, " ".join(passage + [f"own{i}x{j}" for j in range(34)])) for i in range(60)]
    near = words(160, rng)
    table += [(100 + i, " ".join(changed(near, *rng.integers(0, 160, 2)))) for i in range(6)]
    rows, met = [], jaccard._met
    monkeypatch.setattr(jaccard, "_met", lambda open_rows, percent: rows.append(met(open_rows, percent)) or rows[-1])
    monkeypatch.setattr(jaccard, "stage", lambda df, *a, **k: df.localCheckpoint())
    got = {r.doc_id: r.component_id for r in jaccard._groups(docs(table), jaccard.WORDS, jaccard.PERCENT).collect()}
    assert got == {i: c for i, _, c in brute_groups(table)}
    assert rows[0].count() < 60


def test_signatures_differ_in_no_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(12)
    for n in (1, 7, 300, 3_000):
        for common in {0, n // 2, n - 1}:
            both = np.unique(rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64))
            x, y = both[:n], both[len(both) - n:]
            apart = np.bitwise_xor(jaccard.signature(x), jaccard.signature(y)).view(np.uint64)
            assert sum(int(v).bit_count() for v in apart) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_rows_are_told_by_id_without_python(docs, spark):
    """Texts do not go through Python to be dropped by id; brute force, and columns named like those used inside."""
    table = docs([(i if i % 7 else None, f"text {i}", i) for i in range(-500, 500)] + [(5, "again", 1)], ", __word int").withColumn("_word", F.lit(1))
    gone = [i for i in range(-700, 700, 3)] + [None]
    left = rows.without_ids(table, spark.createDataFrame([(i,) for i in gone], "doc_id bigint"))
    assert "MapInArrow" not in left._jdf.queryExecution().executedPlan().toString() and left.columns == table.columns
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in table.collect() if r.doc_id is None or r.doc_id not in gone)
    none = spark.createDataFrame([], "doc_id bigint")
    assert rows.without_ids(table, none).count() == 1001 and rows.without_ids(table.limit(0), none).count() == 0


def test_tasks_give_memory_back_at_their_end(monkeypatch):
    """What a task held is free when its memory is given back, and its batches are all there."""
    import weakref

    held, given = [], []
    monkeypatch.setattr(common, "give_back", lambda: given.append(held[0]() is None))

    def run(batches):
        large = np.zeros(1_000)
        held.append(weakref.ref(large))
        for batch in batches:
            yield batch + large[0]

    task = common.tidy(run)(iter([1, 2, 3]))
    assert next(task) == 1 and given == []
    assert list(task) == [2, 3] and given == [True]
    monkeypatch.undo()
    common.give_back()


def test_substrings_are_exploded_by_the_lengths_of_pieces(spark):
    """Every piece in a unit and every character, in order, and few others on the way; empty rows for blocks beyond the characters."""
    model = pieces.read_model()
    units = [("▁internationally", [7]), ("▁a\x00漢\U0001f600", [1]), ("x", [4, 5, 6]), ("▁", [2, 3]), ("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", [9])]
    got = collections.defaultdict(list)
    for r in pieces._edges(spark.createDataFrame(units, "unit string, blocks array<bigint>").coalesce(1), model).collect():
        got[r.unit].append((r.i, r.n, r.part, r.id, r.score))
    for unit, blocks in units:
        expected = []
        for i in range(max(len(unit), len(blocks))):
            for n in range(1, max(2, min(model.longest, len(unit) - i) + 1)):
                part = unit[i:i + n]
                if n == 1 or part in model.ids:
                    at = model.ids.get(part)
                    expected.append((i + 1, n, part, -1 if at is None else at, None if at is None else model.scores[at]))
        assert got[unit] == expected
    names = ["▁the", "é漢", ""]
    hashes = [r.h % (1 << 64) for r in spark.createDataFrame([(n,) for n in names], "n string").select(F.xxhash64("n").alias("h")).collect()]
    assert hashes == [pieces.xxhash.xxh64_intdigest(n.encode(), 42) for n in names] and pieces._join_key(names) is F.xxhash64


def test_names_that_share_a_hash_are_joined_as_they_are(spark, monkeypatch):
    model = pieces.read_model()
    units = spark.createDataFrame([("▁internationally", [7])], "unit string, blocks array<bigint>")
    plain = pieces._edges(units, model).collect()
    monkeypatch.setattr(pieces.xxhash, "xxh64_intdigest", lambda data, seed: 0)
    assert pieces._edges(units, model).collect() == plain


def test_edges_are_folded_from_numbers(spark):
    """Edges come as two columns of numbers, in batches cut anywhere; units with more blocks than characters keep them all."""
    model = pieces.read_model()
    units = [(u, list(range(n))) for u, n in (
        ("▁internationally", 2), ("x", 5), ("▁a\x00漢\U0001f600é", 1), ("▁", 3), ("#$%&", 4), ("a" * 48, 1), ("y", 1))]
    seen = []
    fold = pieces._merge_fold(model)
    table = spark.createDataFrame(units, "unit string, blocks array<bigint>").coalesce(1)
    numbers = pieces._edges(table, model).selectExpr(pieces._EDGE, "if(n = 1, get(blocks, i - 1), null) as block")
    assert [f.dataType.simpleString() for f in numbers.schema] == ["bigint", "bigint"]
    whole = numbers.toArrow()
    for size in (1, 7, 10_000):
        out = [r for b in fold(iter(whole.combine_chunks().to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert [(r["unit"], r["blocks"]) for r in out] == units
        for r in out:
            ids = [x for i in r["ids"] for x in (model.fallback(chr(-i - 1)) if i < 0 else [i])]
            assert ids == pieces.merge_long(r["unit"], model)


def test_words_of_several_units_are_forgotten_but_units_stay(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pieces, "KNOWN_WORDS", 2)
    model = pieces.read_model()
    cutter = pieces.Cutter(model)
    text = "one, two, three, one two three ab12 one, ▁x"
    units = sorted(cutter.units(set(cutter.words(text[:-3]) + cutter.words(text))))
    encoder = pieces._Encoder(model, cutter, pa.table({
        "unit": units, "ids": pa.array([pieces.merge_long(u, model) for u in units], pa.list_(pa.int32()))}))
    for part in (text[:-3], text, text[:-3]):
        ids = memoryview(b"".join(map(encoder.__getitem__, cutter.words(part)))).cast("i").tolist()
        assert ids == pieces.merge_long("▁" + part.replace(" ", "▁"), model)
        assert len(encoder.made) <= 2
    assert not any(u[1:] in encoder.units for u in units if encoder.bare(u) and u[1:] not in units)
