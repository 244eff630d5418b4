"""Army lists and unit profiles: validation, weapon choice and merging, profiles, suggestions."""

from __future__ import annotations

from bisect import insort
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.operators.lookups import truthy
from meridian.streaming.dice import shared_folder

#: Grades from the best.
GRADES = ("S", "A", "B", "C", "D")


def errors(units: DataFrame, points: int, most: int) -> DataFrame:
    """(list, type, unit, value) of every rule that a list of units (list, unit, role, points, count, warlord) breaks.

    Over the points of the battle size; more than most of a unit, unless it is battleline; no warlord.
    """
    total = F.sum(F.col("points") * F.col("count"))
    whole = units.groupBy("list").agg(total.alias("value"), F.bool_or(F.coalesce("warlord", F.lit(False))).alias("led"))
    found = F.array_compact(F.array(F.when(F.col("value") > points, F.struct(F.lit("OVER_POINTS").alias("type"), F.col("value").alias("value"))), F.when(~F.col("led"), F.struct(F.lit("NO_WARLORD").alias("type"), F.lit(0).cast("long").alias("value")))))
    whole = whole.select("list", F.explode(found).alias("e")).select("list", "e.type", F.lit(None).cast("long").alias("unit"), "e.value")
    role = F.lower(F.coalesce(F.max("role"), F.lit("")))
    many = units.groupBy("list", "unit").agg(F.sum("count").alias("value"), role.alias("role")).filter((F.col("value") > most) & (F.col("role") != "battleline"))
    return whole.unionByName(many.select("list", F.lit("DUPLICATE_LIMIT").alias("type"), "unit", "value"))


def merged_weapons(own: DataFrame, leader: DataFrame) -> DataFrame:
    """own weapons (unit, line, name, ...) and behind them those of the leader whose name is new, each name once."""
    fresh = leader.join(own.select("unit", "name").distinct(), ["unit", "name"], "left_anti")
    first = F.row_number().over(Window.partitionBy("unit", "name").orderBy("line"))
    fresh = fresh.withColumn("__n", first).filter("__n = 1").drop("__n")
    return own.withColumn("from_leader", F.lit(False)).unionByName(fresh.withColumn("from_leader", F.lit(True)))


def chosen_weapons(weapons: DataFrame, attack: str) -> DataFrame:
    """weapons (unit, line, reach, extra, wish) that take part: all ranged ones, or of melee the first and those with extra attacks; a wish overrides."""
    melee = F.col("reach") == "melee"
    place = F.row_number().over(Window.partitionBy("unit", melee & ~F.col("extra")).orderBy("line"))
    default = ~melee if attack == "ranged" else melee & (F.col("extra") | (place == 1))
    return weapons.withColumn("__default", default).filter(F.coalesce("wish", "__default")).drop("__default")


def resolved(units: DataFrame, models: DataFrame, stats: list[str]) -> DataFrame:
    """units with the stats of their model where it gives one that isn't 0; an invulnerable save of a dash counts as none."""
    other = models.select("unit", *(F.col(c).alias(f"__{c}") for c in stats), F.when(~F.col("invulnerable").isin("", "-", "–"), F.regexp_extract("invulnerable", r"^\D*(\d+)", 1).try_cast("long")).alias("__inv"))
    rows = units.join(other, "unit", "left")
    return rows.select("unit", *(truthy(F.col(f"__{c}"), F.col(c)).alias(c) for c in stats), F.coalesce("__inv", "invulnerable").alias("invulnerable"))


def toggled(units: DataFrame, flag: str, groups: Column, chosen: Column) -> DataFrame:
    """In the groups that are touched only the chosen row has the flag, and not if it had it before."""
    return units.withColumn(flag, F.when(groups, chosen & ~F.coalesce(F.col(flag), F.lit(False))).otherwise(F.col(flag)))


def suggestions(units: DataFrame, group: list[str], n: int = 3) -> DataFrame:
    """(unit, better, place): for each unit up to n others of its group with a better grade that cost something, but no more.

    units: group, unit, grade (null: unrated), points, contribution. Best contribution first, then the smaller unit.
    """
    rank = F.array_position(F.array(*map(F.lit, GRADES)), F.col("grade")).cast("int") - 1
    rank = F.when(rank >= 0, rank)
    rows = units.select(*group, "unit", F.col("points").alias("cost"), F.col("contribution").alias("merit"), F.when(F.col("points") > 0, rank).alias("tier"), F.coalesce(rank, F.lit(len(GRADES))).alias("under"), F.lit(None).cast("double").alias("floor"))
    return better(rows, group, n)


def better(units: DataFrame, group: list[str], n: int = 3) -> DataFrame:
    """(unit, better, place): for each unit the n best others of its group that cost no more and stand in a tier before its own bound.

    units: group, unit, cost, merit, tier (from 0; null: never suggested), under (tiers before it are looked at), floor (only merits above it; null: any).
    Most merit first, then the smaller unit; a null merit is the least; units without a cost are left out.

    In order of cost, the n best so far of each tier are all that counts. So a group is cut where it is long: units are dealt by ranges of
    group and cost, each range says what its own best are, those of the ranges before it (few rows for each) are merged, and every range
    is gone through once from there. No task holds more than a range, whatever a group's size, and nothing is paired.
    """
    rows = units.filter("cost is not null").withColumns({"merit": F.coalesce(F.col("merit").cast("double"), F.lit(float("-inf"))), "cost": F.col("cost").cast("double"), "unit": F.col("unit").cast("long")})
    # The ranges are a written table: they have to be the same in both passes.
    at = shared_folder(units.sparkSession, "ranges")
    rows.repartitionByRange(*group, "cost").withColumn("range", F.spark_partition_id()).write.parquet(at)
    rows = units.sparkSession.read.schema(rows.withColumn("range", F.lit(0)).schema).parquet(at)
    place = F.row_number().over(Window.partitionBy("range", *group, "tier").orderBy(F.desc("merit"), "unit"))
    own = rows.filter("tier is not null").withColumn("place", place).filter(F.col("place") <= n).select("range", *group, "tier", "merit", "unit")
    spans = rows.groupBy(*group).agg(F.min("range").alias("lo"), F.max("range").alias("hi")).filter("lo < hi")  # fewer than there are ranges
    reach = rows.select(*group, "range").distinct().join(spans.select(*group), group, "left_semi")
    marks = reach.select("range", *group, F.lit(None).cast("int").alias("tier"), F.lit(None).cast("double").alias("merit"), F.lit(None).cast("long").alias("unit"))
    summaries = own.join(spans.select(*group), group, "left_semi").unionByName(marks)

    def before(part: pd.DataFrame) -> pd.DataFrame:
        """For each range of a group what the ranges before it have left."""
        out, best = [], {}
        for k, found in part.sort_values("range").groupby("range", sort=True):
            out += [(k, tier, merit, unit) for tier, x in best.items() for merit, unit in x]
            for tier, merit, unit in found.dropna(subset=["tier"])[["tier", "merit", "unit"]].itertuples(index=False):
                best[tier] = sorted([*best.get(tier, []), (merit, unit)], key=lambda x: (-x[0], x[1]))[:n]
        made = pd.DataFrame(out, columns=["range", "tier", "merit", "unit"])
        return made.assign(**{c: part[c].iloc[0] for c in group})[["range", *group, "tier", "merit", "unit"]]

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in group)
    start = summaries.groupBy(*group).applyInPandas(before, f"range int, {kinds}, tier int, merit double, unit long")

    def fold(rows: pa.Table, start: pa.Table) -> pa.Table:
        open_: dict = {}
        for *key, tier, merit, unit in zip(*(start[c].to_pylist() for c in (*group, "tier", "merit", "unit")), strict=True):
            open_.setdefault(tuple(key), {}).setdefault(tier, []).append((-merit, unit))
        rows = rows.sort_by([(c, "ascending") for c in (*group, "cost")])
        columns = [rows[c].to_pylist() for c in (*group, "cost", "unit", "merit", "tier", "under", "floor")]
        out = []
        best, group_of = {}, None
        for key, level in groupby(zip(*columns, strict=True), lambda r: r[: len(group) + 1]):
            if key[:-1] != group_of:
                group_of = key[:-1]
                best = {tier: sorted(x) for tier, x in open_.get(group_of, {}).items()}
            level = [r[len(group) + 1 :] for r in level]
            for unit, merit, tier, _, _ in level:
                if tier is not None:
                    insort(best.setdefault(tier, []), (-merit, unit))
                    del best[tier][n:]
            pools: dict = {}
            for unit, _, _, under, floor in level:
                if under not in pools:
                    pools[under] = sorted(x for tier, b in best.items() if tier < under for x in b)[:n]
                out += [(unit, u, k) for k, (less, u) in enumerate(pools[under], 1) if floor is None or -less > floor]
        return pa.table({"unit": pa.array([x[0] for x in out], pa.int64()), "better": pa.array([x[1] for x in out], pa.int64()), "place": pa.array([x[2] for x in out], pa.int32())})

    return rows.groupBy("range").cogroup(start.groupBy("range")).applyInArrow(fold, "unit long, better long, place int")
