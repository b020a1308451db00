"""Operations on the registry of projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import urls
from docquarry.schemas import PROJECTS

# Texts shown for missing settings and the provider used when none is chosen.
MISSING = "N/A"
DEFAULT_PROVIDER = "openai"


def add_projects(existing: DataFrame, new: DataFrame, store_root: str) -> DataFrame:
    """``new(name, url)`` as registry rows; ``reason`` says why a row is refused.

    A name that exists is refused. Of several new rows with one name the smallest URL wins.
    """
    rows = new.select("name", "url").distinct()
    winners = rows.groupBy("name").agg(F.min("url").alias("_winner"))
    taken = existing.select("name", F.lit(True).alias("_taken"))
    collection = urls.collection_name(F.col("url"))
    return (
        rows.join(winners, "name")
        .join(taken, "name", "left")
        .select(
            "name", "url",
            collection.alias("collection_name"),
            F.concat(F.lit(store_root + "/collection_name="), collection).alias("store_path"),
            F.lit(None).cast("string").alias("embedding_provider"),
            F.when(F.col("_taken").isNotNull() | (F.col("url") != F.col("_winner")),
                   "project_exists").alias("reason"),
        )
    )


def accepted(added: DataFrame) -> DataFrame:
    return added.where("reason is null").select(PROJECTS.names)


def list_projects(projects: DataFrame, collections: DataFrame) -> DataFrame:
    """All projects by name with their state.

    ``collections(collection_name, record_count)`` holds a row per stored collection; a
    NULL count marks one that cannot be read.
    """
    joined = projects.join(
        collections.select("collection_name", "record_count", F.lit(True).alias("_stored")),
        "collection_name", "left",
    )
    count = F.col("record_count").cast("string")
    status = (
        F.when(F.col("_stored").isNull(), F.lit("Not indexed"))
        .when(count.isNull(), F.lit("Index may be incomplete"))
        .otherwise(F.concat(F.lit("Indexed ("), count, F.lit(" documents)")))
    )
    return joined.select(
        "name",
        F.coalesce("url", F.lit(MISSING)).alias("url"),
        F.coalesce("collection_name", F.lit(MISSING)).alias("collection_name"),
        status.alias("status"),
    ).orderBy("name")


def resolve_provider(projects: DataFrame, global_provider: str | None = None) -> DataFrame:
    """Provider per project: its own, else the global one, else the default."""
    fallback = F.lit(global_provider or None).cast("string")
    return projects.select(
        "name",
        F.coalesce("embedding_provider", fallback, F.lit(DEFAULT_PROVIDER)).alias("provider"),
    )


def lint_projects(projects: DataFrame) -> DataFrame:
    """Projects whose URL looks like a single page, with the URL to use instead."""
    suggestion = urls.lint_suggestion(F.col("url"))
    return projects.select(
        "name", "url", suggestion.isNotNull().alias("looks_specific"),
        suggestion.alias("suggested_url"),
    )
