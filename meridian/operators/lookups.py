"""Lookups and filters whose terms come as data: keys, optional predicates, defaults, preferred sources, transitions (SRC3, F2, F15, F18, F20, F21, F23, J22, J26, C11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; the filter reaches the scan."""
    return rows.filter(F.col(key) == value).limit(1)


def matching(rows: DataFrame, terms: list[Column | None]) -> DataFrame:
    """Rows for which all given terms hold; None is no term, and without terms all rows stay."""
    return rows.filter(reduce(lambda a, b: a & b, [t for t in terms if t is not None], F.lit(True)))


def visible(rows: DataFrame, role: str, who: str, allowed: list[str]) -> DataFrame:
    """Rows that a user may see: all to those named, without regard to case, else none."""
    return rows.filter(F.lit(who.strip().lower() in {x.strip().lower() for x in allowed}) | (F.col(role) == "public"))


def owned(asked: DataFrame, rows: DataFrame, on: dict[str, str]) -> DataFrame:
    """asked with found and the rest of the row whose id and owner are those asked for (asked's column: rows' column); rows has an id once."""
    own = rows.select(*(F.col(b).alias(f"__{b}") for b in on.values()), *(c for c in rows.columns if c not in on.values()), F.lit(True).alias("__found"))
    same = reduce(lambda x, y: x & y, (asked[a] == own[f"__{b}"] for a, b in on.items()))
    return asked.join(own, same, "left").withColumn("found", F.col("__found").isNotNull()).drop("__found", *(f"__{b}" for b in on.values()))


def truthy(*values: Column) -> Column:
    """The first value that is neither null nor empty, and no number 0 or NaN; the last one where there is none. The text "0" is a value."""
    text = lambda v: F.typeof(v) == "string"
    number = lambda v: F.when(~text(v), v.try_cast("double"))
    empty = lambda v: F.coalesce(F.when(text(v), v.cast("string") == "").otherwise((number(v) == 0) | F.isnan(number(v))), F.lit(False))
    kept = [F.when(~empty(v), v) for v in values[:-1]]
    return F.coalesce(*kept, values[-1])


def named(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a name; a lone dash stands for none."""
    return rows.filter(F.col(name).isNotNull() & ~F.col(name).isin("", "-"))


def moved(rows: DataFrame, status: str, wanted: str, allowed: dict[str, list[str]]) -> DataFrame:
    """rows with accepted, and the status after the wanted transition; one that is not allowed changes nothing."""
    pairs = [f"{a}>{b}" for a, to in allowed.items() for b in to]
    ok = F.coalesce(F.concat_ws(">", status, wanted).isin(pairs), F.lit(False))
    return rows.withColumn("accepted", ok).withColumn(status, F.when(ok, F.col(wanted)).otherwise(F.col(status)))


def mapped(names: DataFrame, name: str, known: DataFrame, by_hand: dict[str, str], plain) -> DataFrame:
    """names with id: by a dictionary first, else where the plain forms of both names are equal. known: (id, name), few rows; the smallest id of a plain form counts."""
    pairs = [F.lit(x) for kv in by_hand.items() for x in kv]
    hand = F.element_at(F.create_map(*pairs), F.col(name)) if pairs else F.lit(None).cast("string")
    forms = known.groupBy(plain(F.col("name")).alias("__plain")).agg(F.min("id").alias("__id"))
    return names.join(forms, plain(F.col(name)) == F.col("__plain"), "left").withColumn("id", F.coalesce(hand, "__id")).drop("__plain", "__id")


def preferred(first: DataFrame, second: DataFrame) -> DataFrame:
    """All of the first source where it has a row, else the second: one plan, in which the second is joined to a row that is there if the first has none.

    That row is broadcast, and where it isn't there the plan is cut at run time before the second source is read.
    """
    none = first.select(F.lit(1).alias("__one")).limit(1).agg(F.count("*").alias("__n")).filter("__n = 0").select(F.lit(1).alias("__one"))
    return first.unionByName(second.withColumn("__one", F.lit(1)).join(F.broadcast(none), "__one", "left_semi").drop("__one"))


def present(rows: DataFrame, name: str = "present") -> DataFrame:
    """One row that tells whether there are rows; one of them is read."""
    return rows.select(F.lit(1).alias("__one")).limit(1).agg((F.count("*") > 0).alias(name))


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    """A source without rows, of a schema."""
    return spark.createDataFrame([], schema)


def cached(asked: DataFrame, results: DataFrame, config: list[str]) -> DataFrame:
    """asked with the hash of its configuration and the result kept under that hash, where there is one."""
    own = F.sha2(F.to_json(F.struct(*config), {"ignoreNullFields": "false"}), 256)
    return asked.withColumn("config_hash", own).join(results.select("config_hash", "result"), "config_hash", "left")
