"""Quality by hierarchical empirical Bayes.

A document's own evidence is a naive Bayes log-ratio over binned text measures. Its site and the
path level below it give the prior: counts of good and bad labelled documents, the path shrunk to
its site and the site to all documents by beta-binomial priors whose strength is fitted from how far
rates spread beyond chance. A sparse site so stays near the global rate. The posterior is the
prior's odds times the evidence. Everything is a grouped aggregation; the model is as large as the
number of measures times bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.session import stage

LEAST_STRENGTH = 2.0
MOST_STRENGTH = 1000.0
SMOOTHING = 1.0
TEMPER = 0.5
BINS = 24


def measures(text: Column) -> dict[str, Column]:
    """Whole-number measures of a text, each in ``0 .. BINS - 1``; characters are counted on the whole text."""
    chars = F.greatest(F.char_length(text), F.lit(1))
    words = F.char_length(text) - F.char_length(F.translate(text, " \n\t", "")) + 1
    lower = "abcdefghijklmnopqrstuvwxyzàâäáçéèêëíîïñóôöúùûüß"

    def count(some: str) -> Column:
        return F.char_length(text) - F.char_length(F.translate(text, some, ""))

    def share(number: Column, scale: float) -> Column:
        return F.least(F.lit(BINS - 1), F.floor(number / chars * scale)).cast("int")

    return {
        "length": F.least(F.lit(BINS - 1), F.floor(F.log2(chars.cast("double")))).cast("int"),
        "word": F.least(F.lit(BINS - 1), F.floor(2.0 * chars / words)).cast("int"),
        "lower": share(count(lower), BINS - 0.001),
        "upper": share(count("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉ"), 4 * BINS),
        "digit": share(count("0123456789"), 6 * BINS),
        "stop": share(count(".,;:!?"), 6 * BINS),
        "mark": share(count("#$%&*|<>{}[]()=+/\\@~^_"), 3 * BINS),
        "line": share(count("\n"), 20 * BINS),
    }


def _fitted(children: DataFrame, parent: list[str]) -> DataFrame:
    """Strength of the beta prior per parent, by moments over its children's rates."""
    rate = F.col("good") / F.col("n")
    sums = children.groupBy(*parent).agg(
        F.count("*").alias("c"), F.sum("good").alias("g"), F.sum("n").alias("t"),
        F.avg(rate).alias("r1"), F.avg(rate * rate).alias("r2"), F.avg(1.0 / F.col("n")).alias("inv"))
    mean = F.col("g") / F.col("t")
    spread = F.col("r2") - F.col("r1") * F.col("r1") - mean * (1 - mean) * F.col("inv")
    strength = F.when(spread > 0, mean * (1 - mean) / spread - 1).otherwise(F.lit(MOST_STRENGTH))
    return sums.select(*parent, F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), strength)).alias("s"))


def priors(labelled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Global, site and path-level posterior rates from ``labelled(site, path, good)``, ``good`` 0 or 1."""
    paths = stage(labelled.groupBy("site", "path").agg(
        F.count("*").cast("double").alias("n"), F.sum("good").cast("double").alias("good")), "paths")
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("one", F.lit(0))
    everything = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).select(
        F.lit(0).alias("one"),
        F.coalesce((F.col("good") + 1) / (F.col("n") + 2), F.lit(0.5)).alias("global_rate"))
    rate = lambda above: (F.col("good") + F.col("s") * F.col(above)) / (F.col("n") + F.col("s"))
    site_level = stage(sites.join(everything, "one").join(_fitted(sites, ["one"]), "one").select(
        "site", rate("global_rate").alias("site_rate")), "sites")
    path_level = paths.join(site_level, "site").join(_fitted(paths, ["site"]), "site").select(
        "site", "path", rate("site_rate").alias("path_rate"))
    return everything.select("global_rate"), site_level, stage(path_level, "path_rates")


def evidence(labelled: DataFrame, names: list[str]) -> DataFrame:
    """``measure, bin, weight``: log-ratio of a bin among good and bad documents, smoothed."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("bin")) for n in names]))
    counts = labelled.select("good", pairs.alias("p")).groupBy("p.measure", "p.bin").agg(
        F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b"))
    totals = labelled.agg(F.sum("good").alias("tg"), F.sum(1 - F.col("good")).alias("tb"))
    part = lambda n, t: (F.col(n) + SMOOTHING) / (F.col(t) + SMOOTHING * BINS)
    return counts.crossJoin(F.broadcast(totals)).select(
        "measure", "bin", F.log(part("g", "tg") / part("b", "tb")).alias("weight"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, evidence, prior, quality, keep`` for every row of ``docs(doc_id, text, source, lang)``.

    ``labels(doc_id, quality)`` marks some documents 1 or 0; site is ``source``, path level is ``source`` with ``lang``. All labelled
    rows are counted, no sample is taken. A document labelled twice counts as good if any label says so; labels with a null are left out.
    Null site or path is a site or path of its own; a null or empty text has the measures of one empty character. Unlabelled sites take the
    global rate; without any label every prior is one half and evidence 0. Repeated rows are all kept; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = measures(text)
    names = list(found)
    measured = stage(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("path"),
        *[c.alias(n) for n, c in found.items()]), "measures")
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"))
    labelled = stage(measured.join(marks, "doc_id"), "labelled")
    everything, sites, paths = priors(labelled.select("site", "path", "good"))
    table = {(r.measure, r.bin): r.weight for r in evidence(labelled, names).collect()}
    weight = {n: [table.get((n, b), 0.0) for b in range(BINS)] for n in names}
    total = sum((F.element_at(F.array(*map(F.lit, weight[n])), F.col(n) + 1) for n in names), F.lit(0.0))
    rates = measured.join(F.broadcast(everything)).join(sites, "site", "left").join(paths, ["site", "path"], "left")
    prior = F.coalesce("path_rate", "site_rate", "global_rate", F.lit(0.5))
    logit = F.log(prior / (1 - prior)) + TEMPER * F.col("evidence")
    return rates.withColumn("evidence", total).withColumn("prior", prior).withColumn(
        "quality", 1 / (1 + F.exp(-logit))).select(
        "doc_id", F.round("evidence", 6).alias("evidence"), F.round("prior", 6).alias("prior"),
        F.round("quality", 6).alias("quality"), (F.col("quality") >= 0.5).alias("keep"))
