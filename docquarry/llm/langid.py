"""Language identification by interpolated Kneser-Ney character models, one per language.

A model predicts every character of a word, and the word's end, from the three characters
ahead of it. Counts of character runs come from all training texts, gathered in tasks and
summed by Spark; the discounts, continuation counts and interpolated probabilities are
aggregations over them. A finished model is a pair of arrays per order, sorted by the whole packed
run, so that a run that was not seen is not found. Models of more than ``MODEL_ENTRIES`` entries or
``MOST_LANGUAGES`` languages take several passes over the texts, each with a part of them, which is what bounds
the broadcast; a language too large for a pass is cut by the character ahead of the predicted one. A text takes the
language of the lowest cross-entropy per character; texts far above the cross-entropy that
labelled texts of that language and length show to models that did not learn them are rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import batch_of, by_size, mix, rows_in, tidy
from docquarry.session import scope, stage

ORDER = 4
CHAR_BITS = 15
PART_BITS = 8
MODEL_ENTRIES = 6_000_000
MOST_LANGUAGES = 64
FLUSH_WORDS = 150_000
SCORED_WORDS = 20_000
SCORED_CHARS = 200_000
COUNTED_WORDS = 50_000
COUNTED_RUNS = 500_000
SURE_CHARS = 200
REJECT_SPREADS = 8.0
LEAST_SPREAD = 0.1
SURE_ROWS = 20
UNDETERMINED = "und"
LONGEST_WORD = 200


def pieces_of(text: str) -> list[str]:
    """Lower-cased words; a longer one is cut into pieces of bounded length."""
    words = text.lower().split()
    if len(text) > LONGEST_WORD and max(map(len, words), default=0) > LONGEST_WORD:
        words = [w[i:i + LONGEST_WORD] for w in words for i in range(0, len(w), LONGEST_WORD)]
    return words


def _runs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed runs of ``ORDER`` characters of all words, and the word each belongs to."""
    pad = " " * (ORDER - 1)
    joined = "".join([f"{pad}{w} " for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    codes = np.where(codes < 1 << CHAR_BITS, codes, mix(codes) >> np.uint64(64 - CHAR_BITS))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + ORDER
    packed = np.zeros(len(codes) - ORDER + 1, dtype=np.uint64)
    for i in range(ORDER):
        packed = packed << np.uint64(CHAR_BITS) | codes[i: len(packed) + i]
    owner = np.repeat(np.arange(len(words)), sizes)[: len(packed)]
    inside = np.arange(len(packed)) - np.repeat(np.cumsum(sizes) - sizes, sizes)[: len(packed)]
    keep = inside < np.repeat(sizes, sizes)[: len(packed)] - ORDER + 1
    return packed[keep], owner[keep]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of all words by language; words are held up to ``COUNTED_WORDS``, runs to about ``COUNTED_RUNS``, of all languages together."""
    schema = pa.schema([("lang", pa.string()), ("run", pa.int64()), ("n", pa.int64())])
    held: dict[str, Counter] = {}
    counted: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def count() -> None:
        for lang, words in held.items():
            runs, owner = _runs(list(words))
            number = np.fromiter(words.values(), dtype=np.int64, count=len(words))[owner]
            if lang in counted:
                runs, number = np.concatenate([counted[lang][0], runs]), np.concatenate([counted[lang][1], number])
            order = np.argsort(runs)
            runs = runs[order]
            starts = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
            counted[lang] = runs[starts], np.add.reduceat(number[order], starts)
        held.clear()

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (run, total) in counted.items():
            yield batch_of(schema, [lang] * len(run), run.view(np.int64), total)
        counted.clear()

    for rows in by_size(rows_in(batches, "lang", "text"), lambda r: len(r[1]), 50_000):
        for lang, text in rows:
            words = pieces_of(text)
            if words:
                held.setdefault(lang, Counter()).update(words)
        if sum(map(len, held.values())) >= COUNTED_WORDS:
            count()
            if sum(len(run) for run, _ in counted.values()) >= COUNTED_RUNS:
                yield from flush()
    count()
    yield from flush()


def train(labelled: DataFrame) -> DataFrame:
    """Model rows ``lang, kind, run, value`` from ``labelled(lang, text)``.

    Kind ``k`` holds the log-probability of runs of ``k`` characters, kind ``-k`` the log-weight
    that a context of ``k - 1`` characters gives to the next lower order. Rows with a null are left out.
    """
    counts = stage(labelled.where("lang is not null and text is not null").select("lang", "text").mapInArrow(
        tidy(_count), "lang string, run bigint, n bigint").groupBy("lang", "run").agg(F.sum("n").alias("c")), "runs")
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        lower = F.col("run").bitwiseAND((1 << CHAR_BITS * order) - 1)
        tables[order] = stage(tables[order + 1].select("lang", lower.alias("run")).groupBy("lang", "run").agg(
            F.count("*").alias("c")), "runs")
    rows, below = [], None
    for order in range(1, ORDER + 1):
        context = F.shiftright("run", CHAR_BITS)
        now = tables[order].withColumn("context", context)
        discount = now.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).select(
            "lang", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("d"))
        # Staged, so that the join below and the model rows do not each count all contexts anew.
        contexts = stage(now.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count("*").alias("types")).join(
            F.broadcast(discount), "lang").withColumn("d", F.least(F.lit(0.95), F.greatest(F.lit(0.05), "d"))).select(
            "lang", "context", "total", "d", (F.col("d") * F.col("types") / F.col("total")).alias("w")), "contexts")
        joined = now.join(contexts, ["lang", "context"])
        own = (F.col("c") - F.col("d")) / F.col("total")
        if below is None:
            known = joined.withColumn("p", own + F.col("w") / F.lit(float(1 << CHAR_BITS)))
        else:
            lower = F.col("run").bitwiseAND((1 << CHAR_BITS * (order - 1)) - 1)
            known = joined.withColumn("lower", lower).join(
                below.select("lang", F.col("run").alias("lower"), F.col("p").alias("q")), ["lang", "lower"]
            ).withColumn("p", own + F.col("w") * F.col("q"))
        below = stage(known.select("lang", "run", "p"), "model")
        rows.append(below.select("lang", F.lit(order).alias("kind"), "run", F.log("p").alias("value")))
        rows.append(contexts.select("lang", F.lit(-order).alias("kind"), F.col("context").alias("run"),
                                    F.log("w").alias("value")))
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out


def _part(run: np.ndarray) -> np.ndarray:
    """Part of a model that scores a run: all that it may look up but single characters lies there."""
    return (mix(run >> np.uint64(CHAR_BITS) & np.uint64((1 << CHAR_BITS) - 1)) >> np.uint64(64 - PART_BITS)).astype(np.int32)


def _with_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("run", pa.int64()), ("value", pa.float64()),
                        ("part", pa.int32())])
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        run = batch.column("run").to_numpy().view(np.uint64)
        part = _part(np.where(kind < 0, run << np.uint64(CHAR_BITS), run))
        yield batch_of(schema, batch.column("lang"), batch.column("kind"), batch.column("run"), batch.column("value"),
                       np.where(np.abs(kind) == 1, -1, part))


def passes(rows: DataFrame) -> list[dict[str, list[int]]]:
    """Parts of languages that each pass takes, about ``MODEL_ENTRIES`` entries of ``rows(lang, part)`` together.

    Part -1, single characters, goes along with every part of its language.
    """
    sizes: dict[str, dict[int, int]] = {}
    for r in rows.groupBy("lang", "part").count().collect():
        sizes.setdefault(r["lang"], {})[r["part"]] = r["count"]
    out: list[dict[str, list[int]]] = []
    filled = 0
    for lang, parts in sorted(sizes.items()):
        single = parts.pop(-1, 0)
        for part in range(1 << PART_BITS):
            n = parts.get(part, 0)
            fresh = not out or lang not in out[-1]
            if not out or filled + n + fresh * single > MODEL_ENTRIES or fresh and len(out[-1]) == MOST_LANGUAGES:
                out.append({})
                filled, fresh = 0, True
            out[-1].setdefault(lang, []).append(part)
            filled += n + fresh * single
    return out


class Models:
    """The sorted arrays of every language, or of those parts of languages that ``parts`` names."""

    def __init__(self, rows: pa.Table, parts: dict[str, list[int]] | None = None):
        self.languages = sorted(set(rows["lang"].to_pylist()) if parts is None else parts)
        self.covered = np.ones((len(self.languages), 1 << PART_BITS), dtype=bool)
        for n, name in enumerate(self.languages if parts is not None else []):
            self.covered[n] = np.isin(np.arange(1 << PART_BITS), parts[name])
        lang = rows["lang"].combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
        if isinstance(lang, pa.ChunkedArray):
            lang = lang.combine_chunks()
        names, lang = lang.dictionary.to_pylist(), lang.indices.to_numpy()
        kind, run = rows["kind"].to_numpy(), rows["run"].to_numpy().view(np.uint64)
        value = rows["value"].to_numpy().astype(np.float32)
        self.arrays = {}
        for n, name in enumerate(self.languages):
            own = np.flatnonzero(lang == names.index(name)) if name in names else np.zeros(0, dtype=np.int64)
            for k in (*range(-ORDER, 0), *range(1, ORDER + 1)):
                mine = own[kind[own] == k]
                mine = mine[np.argsort(run[mine])]
                self.arrays[n, k] = run[mine], value[mine]

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word, end included, a column per language."""
        runs, owner = _runs(words)
        distinct, at = np.unique(runs, return_inverse=True)
        part = _part(distinct)
        out = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        for n in range(len(self.languages)):
            total = np.zeros(len(distinct), dtype=np.float64)
            done = np.zeros(len(distinct), dtype=bool)
            for o in range(ORDER, 0, -1):
                own = distinct & np.uint64((1 << CHAR_BITS * o) - 1)
                value, found = self._look(n, o, own)
                total += np.where(~done & found, value, 0.0)
                done |= found
                value, found = self._look(n, -o, own >> np.uint64(CHAR_BITS))
                total += np.where(~done & found, value, 0.0)
            total += np.where(done, 0.0, -np.log(float(1 << CHAR_BITS)))
            total[~self.covered[n][part]] = 0.0
            out[:, n] = np.bincount(owner, weights=total[at], minlength=len(words))
        return out

    def _look(self, n: int, kind: int, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        runs, values = self.arrays[n, kind]
        if not len(runs):
            return np.zeros(len(run)), np.zeros(len(run), dtype=bool)
        at = np.minimum(np.searchsorted(runs, run), len(runs) - 1)
        return values[at], runs[at] == run


class _Scorer:
    """Scores of words, made for ``SCORED_WORDS`` at a time and remembered up to a bounded number of words."""

    def __init__(self, models: Models):
        self.models, self.place = models, {}
        self.table = np.zeros((0, len(models.languages)), dtype=np.float32)

    def of(self, docs: list[list[str]]) -> Iterator[tuple[np.ndarray, int]]:
        """Log-probability per language and number of predicted characters of every document."""
        if len(self.place) > FLUSH_WORDS:
            self.place, self.table = {}, self.table[:0]
        new = [w for w in dict.fromkeys(w for words in docs for w in words) if w not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            parts = [self.models.scores(new[i:i + SCORED_WORDS]) for i in range(0, len(new), SCORED_WORDS)]
            self.table = np.concatenate([self.table, *parts])
        for words in docs:
            at = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
            yield self.table[at].sum(axis=0, dtype=np.float64), sum(map(len, words)) + len(words)


def cross_entropies(docs: DataFrame, labelled: DataFrame, *also: str) -> DataFrame:
    """``doc_id, lang_pred, score, entropy, n_predicted`` for every row of ``docs(doc_id, text)``.

    ``lang_pred`` is the language of ``labelled(lang, text)`` whose model gives the text the lowest
    cross-entropy per character (``entropy``, in nats); ties go to the smaller name. ``score`` is its share against the other
    languages over at most ``SURE_CHARS`` characters. A text that is null or has no letter, and any text
    if nothing is labelled, is ``und`` with score 0. Words score the same wherever they stand, so a
    text of any length is one sum over its words. Repeated rows are all kept, and columns ``also`` as strings.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         *(F.col(c).cast("string").alias(c) for c in also))
    result = "doc_id bigint, lang_pred string, score double, entropy double, n_predicted bigint"
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                        ("entropy", pa.float64()), ("n_predicted", pa.int64()), *((c, pa.string()) for c in also)])

    def scored(shared, languages: list[str], last: bool, earlier: bool):
        """One pass: adds to the sums per language, and judges by them in the last."""
        names = ["doc_id", "text", *also, *(["sums"] if earlier else [])]
        passed = pa.schema([*narrow_schema, ("sums", pa.list_(pa.float64()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models = shared.value
            place = [languages.index(name) for name in models.languages]
            scorer = _Scorer(models)
            for rows in by_size(rows_in(batches, *names), lambda r: len(r[1] or "") + 100, SCORED_CHARS):
                out = []
                for row, (own, n) in zip(rows, scorer.of([pieces_of(r[1] or "") for r in rows])):
                    doc_id, text, *more = row[:2 + len(also)]
                    sums = np.array(row[-1] if earlier else [0.0] * len(languages))
                    sums[place] += own
                    if not last:
                        out.append((doc_id, text, *more, sums))
                        continue
                    if n == 0 or not languages or not any(map(str.isalpha, text)):
                        out.append((doc_id, UNDETERMINED, 0.0, None, n, *more))
                        continue
                    entropy = -sums / n
                    best = int(entropy.argmin())
                    share = 1.0 / np.exp((entropy[best] - entropy) * min(n, SURE_CHARS)).sum()
                    out.append((doc_id, languages[best], float(share), float(entropy[best]), n, *more))
                yield batch_of(schema if last else passed, *zip(*out))
        return tidy(run)

    narrow_schema = [("doc_id", pa.int64()), ("text", pa.string()), *((c, pa.string()) for c in also)]
    strings = "".join(f", {c} string" for c in also)
    with scope(spark):
        model = stage(train(labelled).mapInArrow(
            tidy(_with_part), "lang string, kind int, run bigint, value double, part int"), "model")
        todo = passes(model) or [{}]
        languages = sorted(set().union(*todo))
        held = narrow
        for number, parts in enumerate(todo):
            rows = model
            if len(todo) > 1:
                rows = model.where(F.lit(False))
                for lang, own in parts.items():
                    rows = rows.union(model.where((F.col("lang") == lang) & ((F.col("part") == -1) | F.col("part").isin(own))))
            shared = spark.sparkContext.broadcast(Models(rows.select("lang", "kind", "run", "value").toArrow(), parts))
            last = number == len(todo) - 1
            run = scored(shared, languages, last, number > 0)
            if last:
                out = held.mapInArrow(run, result + strings)
                return out if number == 0 else stage(out, "scored", keep=True)
            held = stage(held.mapInArrow(run, f"doc_id bigint, text string{strings}, sums array<double>"), "sums")
            shared.destroy()


def in_training(doc_id: Column) -> Column:
    """Whether a document belongs to the four fifths that models learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 != 0


def in_calibration(doc_id: Column) -> Column:
    """Whether a document belongs to the quarter of the training part that the rejection is calibrated on."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def _usual(known: DataFrame, value: Column, *keys: str) -> DataFrame:
    """Rows, median entropy and median absolute deviation per key; ``value`` scales a deviation. Medians are approximate."""
    middle = known.groupBy(*keys).agg(F.percentile_approx("entropy", 0.5).alias("middle"))
    return known.join(F.broadcast(middle), list(keys)).groupBy(*keys, "middle").agg(
        F.count("*").alias("n"),
        (1.4826 * F.percentile_approx(F.abs(F.col("entropy") - F.col("middle")) * value, 0.5)).alias("spread"))


def _limit(spread: Column, middle: Column) -> Column:
    return middle + REJECT_SPREADS * F.greatest(spread, F.lit(LEAST_SPREAD))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, entropy, accepted`` for every row of ``docs(doc_id, text, lang)``.

    Models learn from the training part. The rejection is calibrated on a quarter of it, scored by models that
    learned from the other three only, and there on texts whose ``lang`` is the language found, so that
    texts of no language cannot widen it. Per language and length (in powers of two) a text is accepted if its
    cross-entropy is at most ``REJECT_SPREADS`` deviations above the median; the deviation is the median absolute one, at
    least ``LEAST_SPREAD``. Where fewer than ``SURE_ROWS`` texts show what is usual, the limit is not below that of the language,
    or else of all languages, whose deviation shrinks with the root of the length. Only if no text at all can be calibrated on is
    every language accepted. ``und`` is never accepted. Null ``lang`` is not learned from,
    null ``doc_id`` counts as held out; an empty table gives no rows; other columns are ignored.
    """
    size = F.floor(F.log2(F.greatest("n_predicted", F.lit(1))))
    labelled = docs.where(in_training(F.col("doc_id")))
    found = stage(cross_entropies(docs, labelled), "entropies").withColumns({
        "held_out": ~in_training(F.col("doc_id")), "size": size})
    spare = in_calibration(F.col("doc_id"))
    known = stage(cross_entropies(labelled.where(spare).where("lang is not null"), labelled.where(~spare), "lang").where(
        "lang = lang_pred and entropy is not null"), "calibration").withColumns({"size": size, "one": F.lit(0)})
    root = F.sqrt("n_predicted")
    bins = _usual(known, F.lit(1.0), "lang_pred", "size").select(
        "lang_pred", "size", _limit(F.col("spread"), F.col("middle")).alias("own"), (F.col("n") >= SURE_ROWS).alias("sure"))
    languages = _usual(known, root, "lang_pred").select("lang_pred", F.struct("middle", "spread").alias("of_language"))
    overall = _usual(known, root, "one").select("one", F.struct("middle", "spread").alias("of_all"))
    broad = F.coalesce("of_language", "of_all")
    limit = F.when(F.col("sure"), F.col("own")).otherwise(
        F.greatest("own", _limit(broad["spread"] / root, broad["middle"])))
    return found.withColumn("one", F.lit(0)).join(F.broadcast(bins), ["lang_pred", "size"], "left").join(
        F.broadcast(languages), "lang_pred", "left").join(F.broadcast(overall), "one", "left").select(
        "doc_id", "held_out", "lang_pred", "score", "entropy",
        (F.col("entropy").isNotNull() & (F.col("entropy") <= F.coalesce(limit, "entropy"))).alias("accepted"))
