"""Entity resolution between catalogues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.white import trimmed


def normal(name: Column) -> Column:
    """Lower case, marks as spaces, single spaces."""
    return trimmed(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def best_match(left: DataFrame, right: DataFrame, prefer: tuple[str, str], order: str) -> DataFrame:
    """left (id, key, ...) with the matched id of right (other, key, ...): candidates alike in the preferred columns (left's, right's) first, then by order; null without one.

    Each key's first candidate, and each key and preferred value's, are found before the joins, so that a key with many rows on both
    sides costs its rows and not their pairs.
    """
    own, theirs = prefer
    first = F.min(F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("order"), F.col("other").alias("other"))).alias("first")
    alike = right.groupBy("key", F.col(theirs).alias("__theirs")).agg(first)
    of_key = alike.groupBy("key").agg(F.min("first").alias("first"))
    rows = left.alias("l").join(of_key.alias("k"), F.col("l.key") == F.col("k.key"), "left").join(alike.alias("a"), (F.col("l.key") == F.col("a.key")) & (F.col(f"l.{own}") == F.col("a.__theirs")), "left")
    found = rows.select("l.*", F.col("a.first").isNull().alias("__other_kind"), F.coalesce("a.first", "k.first").alias("__first"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("__other_kind", F.col("__first").asc_nulls_last()))
    return found.withColumn("__rank", rank).filter("__rank = 1").select(*left.columns, F.col("__first.other").alias("other"))


def account(names: DataFrame, users: DataFrame) -> DataFrame:
    """names (name) with the id of the first user (id, username, display) whose username or display name it equals, case and outer space aside."""
    keys = users.select("id", F.explode(F.array("username", "display")).alias("key")).select("id", F.lower(trimmed("key")).alias("key")).groupBy("key").agg(F.min("id").alias("user"))
    return names.withColumn("key", F.lower(trimmed("name"))).join(keys, "key", "left").drop("key")


def cascade(left: DataFrame, right: DataFrame, steps: list[tuple[Callable[[Column], Column], float]], order: Column) -> DataFrame:
    """left (id, name, ...) with other and score of the first step that makes the names equal; of equal names in right (other, name) the last by order counts.

    Steps change left's name only; both columns are null without a match. Each step's rows are joined once, on one shuffled key.
    """
    known = right.groupBy("name").agg(F.max_by("other", order).alias("other"))
    tries = F.explode(F.array(*(F.struct(step(F.col("name")).alias("key"), F.lit(score).alias("score")) for step, score in steps))).alias("t")
    found = left.select("id", tries).select("id", "t.*").join(known, F.col("key") == F.col("name")).groupBy("id").agg(F.max(F.struct("score", "other")).alias("m")).select("id", "m.other", "m.score")
    return left.join(found, "id", "left")


def rekey(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """column's values by mapping (old, new); a value that it lacks stays."""
    return rows.join(mapping, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("new", column)).select(*rows.columns)
