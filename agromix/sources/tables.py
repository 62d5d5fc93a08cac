"""Reading the Parquet tables of a data folder through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

__all__ = ["table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; any path that Spark can open will do."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
