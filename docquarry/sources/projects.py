"""The registry of projects as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.schemas import PROJECTS


def read_projects(spark: SparkSession, path: str, one_file_each: bool = False) -> DataFrame:
    """Registry rows: JSON lines, or a folder per project that holds one JSON object."""
    if one_file_each:
        path = f"{path.rstrip('/')}/*/project.json"
    return spark.read.schema(PROJECTS).json(path, multiLine=one_file_each)


def write_projects(projects: DataFrame, path: str) -> None:
    projects.select(PROJECTS.names).write.mode("overwrite").json(path)


def find_projects(projects: DataFrame, names: DataFrame) -> DataFrame:
    """Requested ``names(name)`` with their settings; unknown ones carry an error."""
    known = projects.withColumn("_known", F.lit(True))
    return names.select("name").join(known, "name", "left").select(
        *PROJECTS.names,
        F.when(F.col("_known").isNull(), "project_not_found").alias("error"),
    )
