"""URL filter by host reputation: beta-binomial shrinkage from host to domain to suffix.

Labelled pages give every host a count of pages and of bad pages. A level's posterior mean
is its own counts shrunk to the mean of the level above: suffix to all pages, registered
domain to suffix, host to domain. The strength of each prior is fitted by moments from how
far the level's rates spread beyond what chance explains. A host is blocked if the lower
bound of its posterior rate of bad pages lies above a limit. Explicit rules come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.session import stage

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LIMIT = 0.25
Z = 1.645
LEAST_STRENGTH = 2.0
MOST_STRENGTH = 1000.0


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """Last label of a host."""
    return F.substring_index(host, ".", -1)


def domain_of(host: Column) -> Column:
    """Last two labels of a host."""
    return F.substring_index(host, ".", -2)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as ``struct(rule, verdict)``; null if none does."""
    fitting = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0]))
    ]
    return F.coalesce(*fitting) if fitting else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(children: DataFrame, parent: list[str]) -> DataFrame:
    """Prior strength per parent by moments: rate*(1-rate)/spread beyond chance, minus 1."""
    rate = F.col("bad") / F.col("n")
    sums = children.groupBy(*parent).agg(
        F.count("*").alias("c"), F.sum("n").alias("pn"), F.sum("bad").alias("pbad"),
        F.sum(rate * rate).alias("r2"), F.sum(rate).alias("r1"), F.sum(1.0 / F.col("n")).alias("inv"),
    )
    c, mean = F.col("c"), F.col("pbad") / F.col("pn")
    spread = F.col("r2") / c - (F.col("r1") / c) * (F.col("r1") / c)
    chance = mean * (1 - mean) * F.col("inv") / c
    fitted = F.when(spread > chance, mean * (1 - mean) / (spread - chance) - 1).otherwise(F.lit(MOST_STRENGTH))
    return sums.select(*parent, "pn", "pbad", F.greatest(
        F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), fitted)).alias("s"))


def reputations(outcomes: DataFrame) -> DataFrame:
    """Posterior per labelled host: ``(host, domain, suffix, n, bad, mean, low)``.

    ``outcomes(host, bad)`` holds a row per labelled page, ``bad`` 0 or 1; rows with a null in
    either are left out. Also gives rows for a domain or a suffix as a whole, which answer for
    hosts without labels: there ``host`` is null, and ``domain`` too for a suffix; the row for
    all pages has nulls only. Counts are pre-aggregated, so a host with most rows is no burden.
    """
    known = outcomes.where("host is not null and bad is not null")
    hosts = stage(known.groupBy("host").agg(
        F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"),
    ).withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")

    def total(keys):
        return hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    everything = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where("n > 0").select(
        F.lit(0).alias("one"), "n", "bad", ((F.col("bad") + 1) / (F.col("n") + 2)).alias("mean"),
        (F.col("n") + 2).alias("weight"))
    suffixes = total(["suffix"]).withColumn("one", F.lit(0))
    domains = total(["domain", "suffix"])

    def shrunk(level: DataFrame, above: DataFrame, key: str) -> DataFrame:
        prior = above.select(key, F.col("mean").alias("m0"))
        strength = _strength(level, [key]).select(key, "s")
        s, m0 = F.col("s"), F.col("m0")
        return level.join(prior, key).join(strength, key).select(
            *level.columns, ((F.col("bad") + s * m0) / (F.col("n") + s)).alias("mean"),
            (F.col("n") + s).alias("weight"))

    suffix_level = shrunk(suffixes, everything, "one")
    domain_level = shrunk(domains, suffix_level, "suffix")
    host_level = shrunk(hosts, domain_level.select("domain", "mean"), "domain")

    def shaped(df, *present):
        none = F.lit(None).cast("string")
        mean, weight = F.col("mean"), F.col("weight")
        low = mean - Z * F.sqrt(mean * (1 - mean) / (weight + 1))
        return df.select(
            *[(F.col(c) if c in present else none).alias(c) for c in ("host", "domain", "suffix")],
            "n", "bad", "mean", low.alias("low"))

    return (shaped(host_level, "host", "domain", "suffix")
            .unionByName(shaped(domain_level, "domain", "suffix"))
            .unionByName(shaped(suffix_level, "suffix")).unionByName(shaped(everything)))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES,
                limit: float = LIMIT) -> DataFrame:
    """A verdict per row of ``pages(page_id, url)``: ``page_id, host, path, rule, verdict, bad_rate_low``.

    The longest fitting rule decides, else the host's posterior: ``block`` if its lower bound
    is above ``limit``, else ``allow``. Hosts without labels take the posterior of their
    domain, then suffix, then all pages; without any label everything is allowed. A null url
    or one without ``://`` has an empty host and path. Repeated rows are all kept. ``rules`` is a
    short list kept in the plan. Each distinct host is judged once; pages meet the verdict by a
    join on the host that Spark can split where one host has many pages.
    """
    narrow = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = stage(reputations(outcomes), "reputation")
    names = narrow.select("host").distinct().select(
        "host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))

    def of(level, key, name):
        return known.where(level).select(*([key] if key else []), F.col("low").alias(name))

    judged = (
        names.join(of("host is not null", "host", "l1"), "host", "left")
        .join(of("host is null and domain is not null", "domain", "l2"), "domain", "left")
        .join(of("domain is null and suffix is not null", "suffix", "l3"), "suffix", "left")
        .join(of("host is null and domain is null and suffix is null", None, "l4").groupBy().agg(F.max("l4").alias("l4"))
              .withColumn("_one", F.lit(1)), F.lit(1) == F.col("_one"), "left")
    )
    verdicts = stage(judged.select("host", F.coalesce("l1", "l2", "l3", "l4", F.lit(0.0)).alias("low")), "verdicts")
    found = matching_rule(F.col("host"), F.col("path"), rules)
    return narrow.join(verdicts, "host").withColumn("_found", found).select(
        "page_id", "host", "path", F.col("_found.rule").alias("rule"),
        F.coalesce(F.col("_found.verdict"), F.when(F.col("low") > limit, "block").otherwise("allow")).alias("verdict"),
        F.round("low", 9).alias("bad_rate_low"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of labelled pages: the number that ends a page's path names its document."""
    numbered = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select(
        "host", F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})[^/]*$', 1), '') as bigint)").alias("doc_id"))
    bad = labels.groupBy("doc_id").agg(
        F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    return numbered.where("doc_id is not null").join(bad, "doc_id").select("host", "bad")
