"""Overviews, roll-ups and completeness reports, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions import text
from meridian.plans.registry import query
from meridian.sources.views import table

_COUNTED = {"people": ("customer", "supplier"), "play": ("orders", "lineitem"), "content": ("part", "documents", "pages"), "app": ("events", "conversations")}


@query("overview_nested", "SELECT to_json({" + ", ".join(f"{group}: {{" + ", ".join(f"{t}: (SELECT count(*) FROM {t})" for t in tables) + "}" for group, tables in _COUNTED.items()) + "})::VARCHAR AS overview")
def overview_nested(spark: SparkSession, d: str) -> DataFrame:
    """One row: the counts of all tables, nested by area (A2). Each count is one row."""
    names = [t for tables in _COUNTED.values() for t in tables]
    rows = reduce(DataFrame.union, (table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in names))
    counts = rows.agg(*(F.sum(F.when(F.col("name") == t, F.col("n"))).alias(t) for t in names))
    return counts.select(F.to_json(F.struct(*(F.struct(*tables).alias(group) for group, tables in _COUNTED.items()))).alias("overview"))


@query("player_search_rollup", """WITH found AS (SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%1%' ORDER BY c_name, c_custkey LIMIT 25),
o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM found))
SELECT c_custkey, c_name, count(o_orderkey) AS registrations, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), '') AS factions, count(*) FILTER (o_orderstatus = 'P') AS yellow, count(*) FILTER (o_orderstatus = 'F') AS red,
  coalesce(string_agg(CASE WHEN n <= 5 THEN o_orderkey END, ',' ORDER BY n), '') AS events FROM found LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1, 2""")
def player_search_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 players found by name: their registrations, factions, cards, and the five latest events (A14). The 25 are broadcast."""
    found = table(spark, d, "customer").filter(F.col("c_name").ilike("%1%")).select("c_custkey", "c_name").orderBy("c_name", "c_custkey").limit(25)
    rows = table(spark, d, "orders").join(F.broadcast(found.select("c_custkey")), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    sums = rows.groupBy("o_custkey").agg(F.count("*").alias("registrations"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("factions"), F.count_if(F.col("o_orderstatus") == "P").alias("yellow"), F.count_if(F.col("o_orderstatus") == "F").alias("red"))
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    latest = rows.withColumn("n", n).filter("n <= 5").groupBy(F.col("o_custkey").alias("key")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "o_orderkey"))), lambda e: e["o_orderkey"]), ",").alias("events"))
    out = found.join(sums, F.col("c_custkey") == F.col("o_custkey"), "left").join(latest, F.col("c_custkey") == F.col("key"), "left")
    return out.select("c_custkey", "c_name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("registrations", "yellow", "red")), *(F.coalesce(c, F.lit("")).alias(c) for c in ("factions", "events")))


@query("nested_lengths", """SELECT o_orderdate, CAST(sum(CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 1 + o_orderkey % 3 END) AS BIGINT) AS players FROM orders GROUP BY 1""")
def nested_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Players in all records of a day's JSON texts; a text that can't be read counts 0."""
    k = F.col("o_orderkey")
    players = F.array_join(F.array_repeat(F.lit('{"id":1}'), (k % 3).cast("int")), ",")
    raw = F.when(k % 5 == 0, F.lit('[{"players":[')).when(k % 5 == 1, F.lit("[]")).otherwise(F.concat(F.lit('[{"players":['), players, F.lit(']},{"players":[{"id":2}]},{}]')))
    size = F.aggregate(F.from_json(raw, "array<struct<players: array<struct<id: long>>>>"), F.lit(0).cast("long"), lambda a, r: a + F.coalesce(F.size(r["players"]), F.lit(0)))
    return table(spark, d, "orders").select("o_orderdate", F.coalesce(size, F.lit(0)).alias("n")).groupBy("o_orderdate").agg(F.sum(F.greatest("n", F.lit(0))).alias("players"))


_ENHANCED = "CASE WHEN l_suppkey % 4 = 0 THEN l_suppkey % 25 END"


@query("army_total", f"SELECT l_orderkey AS list, CAST(sum((l_partkey % 90) * (l_linenumber % 3 + 1)) + coalesce(sum({_ENHANCED}), 0) AS BIGINT) AS points, CAST(2000 - (sum((l_partkey % 90) * (l_linenumber % 3 + 1)) + coalesce(sum({_ENHANCED}), 0)) AS BIGINT) AS remaining FROM lineitem GROUP BY 1")
def army_total(spark: SparkSession, d: str) -> DataFrame:
    """Points of units by their number, with enhancements, and what is left of 2000."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("list"), (F.col("l_partkey") % 90).alias("points"), (F.col("l_linenumber") % 3 + 1).alias("count"), F.expr(_ENHANCED).alias("enhancement"))
    total = F.sum(F.col("points") * F.col("count") + F.coalesce("enhancement", F.lit(0)))
    return rows.groupBy("list").agg(total.alias("points"), (2000 - total).alias("remaining"))


_PARTS = {"customers": ("customer", "c_nationkey", "true"), "rich": ("customer", "c_nationkey", "c_acctbal > 9000"), "suppliers": ("supplier", "s_nationkey", "true"), "debtors": ("supplier", "s_nationkey", "s_acctbal < 0"), "builders": ("customer", "c_nationkey", "c_mktsegment = 'BUILDING'")}
_COUNTS_SQL = "c AS (SELECT n_name AS faction, " + ", ".join(f"(SELECT count(*) FROM {t} WHERE {k} = n_nationkey AND {w}) AS {name}" for name, (t, k, w) in _PARTS.items()) + " FROM nation)"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Five counts for each faction, 0 where there is nothing, and whether all are above 0: one pass over each table."""
    out = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("faction"))
    for source, key in {(t, k) for t, k, _ in _PARTS.values()}:
        own = {name: w for name, (t, _, w) in _PARTS.items() if t == source}
        out = out.join(table(spark, d, source).groupBy(F.col(key).alias("n_nationkey")).agg(*(F.count_if(F.expr(w)).alias(name) for name, w in own.items())), "n_nationkey", "left")
    whole = reduce(Column.__and__, (F.col(c) > 0 for c in _PARTS))
    return out.fillna(0, list(_PARTS)).select("faction", *_PARTS).withColumn("complete", whole)


@query("completeness_by_faction", f"WITH {_COUNTS_SQL} SELECT *, {' AND '.join(f'{c} > 0' for c in _PARTS)} AS complete FROM c")
def completeness_by_faction(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


@query("complete_factions", f"WITH {_COUNTS_SQL} SELECT count(*) AS factions, count(*) FILTER ({' AND '.join(f'{c} > 0' for c in _PARTS)}) AS complete FROM c")
def complete_factions(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).agg(F.count("*").alias("factions"), F.count_if("complete").alias("complete"))


@query("units_and_weapons", "SELECT p_brand AS faction, count(DISTINCT p_partkey) AS units, count(l_orderkey) AS weapons FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def units_and_weapons(spark: SparkSession, d: str) -> DataFrame:
    """Units of each faction and the weapons that these have (A34); weapons are counted by unit before the join."""
    weapons = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "part").join(weapons, "p_partkey", "left").groupBy(F.col("p_brand").alias("faction")).agg(F.count("*").alias("units"), F.coalesce(F.sum("n"), F.lit(0)).alias("weapons"))


@query("unmatched", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unmatched(spark: SparkSession, d: str) -> DataFrame:
    """What a coverage report leaves unmatched (Q4)."""
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("first_model", """WITH m AS (SELECT l_orderkey AS unit, min(CAST(l_linenumber * 5 AS VARCHAR)) AS line FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
SELECT o_orderkey AS unit, c_name AS source, CAST(line AS BIGINT) AS line FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN m ON unit = o_orderkey""")
def first_model(spark: SparkSession, d: str) -> DataFrame:
    """Units with their source and first model, if any; lines are texts, so 10 comes before 5."""
    line = (F.col("l_linenumber") * 5).cast("string")
    models = table(spark, d, "lineitem").filter("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(line).cast("long").alias("line"))
    sources = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("source"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(sources, "o_custkey", "left").join(models, "o_orderkey", "left").select(F.col("o_orderkey").alias("unit"), "source", "line")


@query("factions_of_players", "SELECT DISTINCT c_mktsegment AS segment, n_name AS faction, p_brand AS brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey")
def factions_of_players(spark: SparkSession, d: str) -> DataFrame:
    """Which combinations occur over four joins."""
    line, orders, customer, nation, part = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "part"))
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("faction"), F.col("p_brand").alias("brand")).distinct()


@query("adapter_search", "SELECT p_partkey, p_name FROM part WHERE lower(p_brand) LIKE '%#1%' AND lower(p_name) LIKE '%a%' ORDER BY p_name, p_partkey LIMIT 40")
def adapter_search(spark: SparkSession, d: str) -> DataFrame:
    """Units whose faction and name contain the texts asked for, by name, at most 40."""
    asked = {"p_brand": "#1", "p_name": "A"}
    hits = reduce(Column.__and__, (F.lower(c).contains(x.lower()) for c, x in asked.items()))
    return table(spark, d, "part").filter(hits).orderBy("p_name", "p_partkey").limit(40).select("p_partkey", "p_name")


@query("title_case_quotes", "WITH w AS (SELECT p_partkey, lower(p_brand) || ' o''neil''s ' || lower(p_type) AS name FROM part) SELECT p_partkey, array_to_string(list_transform(string_split(name, ' '), lambda x: upper(x[1:1]) || x[2:]), ' ') AS name FROM w")
def title_case_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Names with curly quotes and capitals after them."""
    return table(spark, d, "part").select("p_partkey", text.title(F.concat("p_brand", F.lit(" O’NEIL‘S "), F.upper("p_type"))).alias("name"))


@query("guarded_list", "SELECT o_orderkey FROM orders WHERE false")
def guarded_list(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a list of players that is empty."""
    wanted: list[int] = []
    return table(spark, d, "orders").filter(F.col("o_custkey").isin(wanted)).select("o_orderkey")


@query("damage_histogram", "SELECT CAST(floor(l_quantity / 5) AS BIGINT) * 5 AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def damage_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Counts by bin, in order of the bins."""
    return table(spark, d, "lineitem").groupBy((F.floor(F.col("l_quantity") / 5) * 5).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin")
