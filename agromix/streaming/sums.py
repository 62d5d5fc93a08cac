"""Cross-products kept up to date from a stream: they add up, so a model can be refitted after any batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["moments", "running_moments"]


def moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, sum and sum of squares of ``value`` by group: all that a one-way model needs. Works on streams as on tables."""
    y = F.col(value).cast("double")
    return df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sum(y).alias("sum_y"), F.sum(y * y).alias("sum_yy"))


def running_moments(stream: DataFrame, by: Sequence[str], value: str, name: str):
    """Starts a query that keeps moments() of the whole stream in the in-memory table ``name``; returns the query."""
    return moments(stream, by, value).writeStream.outputMode("complete").format("memory").queryName(name).start()
