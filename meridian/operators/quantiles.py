"""Exact percentiles from histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n). Histograms of parts are added up by another sum, so they merge in any order."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def percentiles(counts: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share) from a histogram: the value at place floor(n * share), from 0, of the sorted rows; the last one for 1.

    Only distinct values are sorted; a group has one row for each.
    """
    so_far = F.sum("n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select(*by, value, so_far.alias("__upto"), F.sum("n").over(Window.partitionBy(*by)).alias("__all"))
    place = lambda p: F.least(F.floor(F.col("__all") * p), F.col("__all") - 1)
    return placed.groupBy(*by).agg(*(F.min(F.when(F.col("__upto") > place(p), F.col(value))).alias(name) for name, p in shares.items()))
