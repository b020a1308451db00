"""A training corpus from raw documents: language, near copies, repeated passages, benchmarks, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. All but the
last return the columns of ``documents``. Null ids and texts, empty tables and repeated rows follow the rules of the
operators; no stage needs more than the columns ``doc_id``, ``text``, ``lang``, ``source`` and ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import decontam, jaccard, langid, pieces, repeats, rows
from docquarry.llm.common import read
from docquarry.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is of a known language; without letters or far off any language they go."""
    found = stage(langid.identify(docs), "languages")
    return rows.without_ids(docs.select(COLUMNS), found.where("not accepted").select("doc_id"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the least id."""
    groups = stage(jaccard.similar_groups(docs), "groups")
    return rows.one_per_group(docs.select(COLUMNS), groups)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur more than once; a character cut in two goes whole."""
    kept = repeats.without_repeats(docs.select(COLUMNS))
    left = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("�"), F.lit(""))
    changed = F.col("n_removed") > 0
    return kept.withColumn("_left", left).select(
        "doc_id", F.when(changed, F.col("_left")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(changed, F.char_length("_left").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontam.without_contaminated(docs.select(COLUMNS), read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and the text read back from them."""
    return pieces.encode(docs.select(COLUMNS), decoded=True)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("no_benchmarks", no_benchmarks),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
