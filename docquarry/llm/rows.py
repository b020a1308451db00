"""Dropping rows of a table of texts by id without shuffling the texts that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.session import split_by


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is null or not in ``ids(doc_id)``; all columns are kept."""
    maybe, others = split_by(docs, "doc_id", ids)
    return others.union(maybe.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns))


def one_per_group(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stand for their group of ``groups(doc_id, n_shingles, component_id)``.

    Those whose ``doc_id`` is their group's least, null ones, and those without shingles; rows that repeat a
    ``doc_id`` count as one, and which of them stays is not defined.
    """
    fate = groups.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.max((F.col("component_id") != F.col("doc_id")).cast("int")).alias("__drop"))
    fate = fate.where("__drop = 1 or rows > 1").select("doc_id", "__drop")
    maybe, others = split_by(docs, "doc_id", fate)
    known = maybe.join(fate, "doc_id", "left")
    kept = known.where("__drop is null").select(docs.columns).union(
        known.where("__drop = 0").select(docs.columns).dropDuplicates(["doc_id"]))
    return others.union(kept)
