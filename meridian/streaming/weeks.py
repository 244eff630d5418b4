"""Counts by week of event time (ST5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly(events: DataFrame, *by: str, at: str = "ts", late: str = "1 day") -> DataFrame:
    """events as a stream: (week, by, n) of each week from Monday on, once it is over.

    A week is given by the first batch after one with an event later than its end by more than late. Until then, and in that batch, its
    events count in whatever order they come; those that come afterwards are dropped, so a week that has been given is never changed.
    State holds the open weeks only.
    """
    rows = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    week = F.window("__at", "7 days", startTime="4 days")  # the epoch was a Thursday
    return rows.groupBy(week.alias("w"), *by).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("week"), *by, "n")
