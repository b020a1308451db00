"""Stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.schemas import PAGES
from docquarry.session import spread


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, url, html)`` with one row per URL; unused columns are never read."""
    return spread(spark.read.schema(PAGES).parquet(path))
