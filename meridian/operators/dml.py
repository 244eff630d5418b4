"""Table changes as joins: upsert, child replacement, deletes, ignored inserts, key checks (SNK3 to SNK10, A32)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, new: DataFrame, keys: list[str], insert_only: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace those of equal key; insert-only columns of existing rows stay."""
    b, n = base.withColumn("__b", F.lit(True)).alias("b"), new.withColumn("__n", F.lit(True)).alias("n")
    both = b.join(n, [F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    pick = lambda c: F.when(F.col("n.__n").isNotNull() & (F.lit(c not in insert_only) | F.col("b.__b").isNull()), F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return both.select(*(pick(c) for c in base.columns))


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in new give way to the new ones."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").select(*children.columns).unionByName(new)


def insert_or_ignore(base: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first new row of each key that base hasn't; base stays as it is."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    fresh = new.join(base.select(*keys).distinct(), keys, "left_anti").withColumn("__first", first).filter("__first = 1").select(*base.columns)
    return base.unionByName(fresh)


def delete_or_hide(rows: DataFrame, chosen: Column, keep: Column, hidden: str, at: Column) -> DataFrame:
    """Of the chosen rows those to keep are hidden, the others go."""
    return rows.filter(~chosen | keep).withColumn(hidden, F.when(chosen, at).otherwise(F.col(hidden)))


def orphans(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Rows without a parent, counted by check (name, child, child key, parent, parent key); a check without any has a count of 0."""
    found = [c.filter(F.col(ck).isNotNull()).join(p, F.col(ck) == F.col(pk), "left_anti").agg(F.lit(name).alias("check"), F.count("*").alias("violations")) for name, c, ck, p, pk in checks]
    return reduce(DataFrame.unionByName, found)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows; keys with a null are no duplicates."""
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def patched(base: DataFrame, patch: DataFrame, keys: list[str], given: str | None = None) -> DataFrame:
    """base with the patch's columns where it gives a value; one patch row a key, unknown keys change nothing.

    given: a column of the patch with the names of the columns that a row sets, also to null; without it a null is no value.
    """
    some = [c for c in patch.columns if c not in keys and c != given]
    new = patch.select(*keys, F.lit(True).alias("__patched"), *(F.col(c).alias(f"__{c}") for c in some), *([F.col(given).alias("__given")] if given else []))
    sets = lambda c: F.coalesce(F.col("__patched") & F.array_contains("__given", c), F.lit(False)) if given else F.col(f"__{c}").isNotNull()
    return base.join(new, keys, "left").select(*(F.when(sets(c), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in some else F.col(c) for c in base.columns))


def cascade_delete(rows: DataFrame, chosen: Column, key: str, children: list[tuple[DataFrame, str, str | None]]) -> list[DataFrame]:
    """What is left of rows and of each level of children (table, its parent's key, its own key) below them."""
    gone, left = rows.filter(chosen).select(F.col(key).alias("__gone")).distinct(), [rows.filter(~F.coalesce(chosen, F.lit(False)))]
    for child, parent, own in children:
        left.append(child.join(gone, F.col(parent) == F.col("__gone"), "left_anti"))
        if own:
            gone = child.join(gone, F.col(parent) == F.col("__gone"), "left_semi").select(F.col(own).alias("__gone")).distinct()
    return left
