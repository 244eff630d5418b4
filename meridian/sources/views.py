"""Competitive-event shapes over the test tables; every view is a declarative DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per player entry: event, date, format, placement, faction, detachment, wins, losses, draws, points."""
    line, orders, supplier, nation, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier", "nation", "part"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    home = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("faction"))
    rows = line.withColumn("placement", place).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(home, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("o_orderkey").alias("event"), F.to_date("o_orderdate").alias("event_date"), F.col("o_orderpriority").alias("format"), "placement", "faction", F.col("p_type").alias("detachment"),
        (F.col("l_quantity").cast("int") % 6).cast("long").alias("wins"), (F.col("l_linenumber") % 4).cast("long").alias("losses"), (F.col("l_returnflag") == "N").cast("long").alias("draws"), F.col("l_extendedprice").alias("points"),
    )


ENTRIES_SQL = """entries AS (SELECT o_orderkey AS event, CAST(o_orderdate AS DATE) AS event_date, o_orderpriority AS format,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS placement, n_name AS faction, p_type AS detachment,
  CAST(l_quantity AS INT) % 6 AS wins, l_linenumber % 4 AS losses, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS draws, l_extendedprice AS points
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""


def pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive orders of a month play each other; the last of an odd number has a bye."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    rn = F.row_number().over(Window.partitionBy("event").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, sf_dir, "orders").withColumn("event", month).withColumn("rn", rn).withColumn("game", F.expr("(rn + 1) div 2"))
    side = lambda i: F.max(F.when(F.col("rn") % 2 == i, F.struct(F.col("o_custkey").alias("player"), (F.floor("o_totalprice") % 101).cast("long").alias("vp"))))
    both = rows.groupBy("event", "game").agg(side(1).alias("a"), side(0).alias("b"))
    result = F.when(F.col("b").isNull(), "BYE").when(F.col("a.vp") > F.col("b.vp"), "P1").when(F.col("a.vp") < F.col("b.vp"), "P2").otherwise("DRAW")
    return both.select("event", "game", F.col("a.player").alias("p1"), F.col("a.vp").alias("vp1"), F.col("b.player").alias("p2"), F.col("b.vp").alias("vp2"), result.alias("result"))


PAIRINGS_SQL = """ranked AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS event, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
halves AS (SELECT event, (rn + 1) // 2 AS game, rn % 2 AS side, o_custkey AS player, CAST(floor(o_totalprice) AS BIGINT) % 101 AS vp FROM ranked),
pairings AS (SELECT a.event, a.game, a.player AS p1, a.vp AS vp1, b.player AS p2, b.vp AS vp2,
  CASE WHEN b.player IS NULL THEN 'BYE' WHEN a.vp > b.vp THEN 'P1' WHEN a.vp < b.vp THEN 'P2' ELSE 'DRAW' END AS result
  FROM (SELECT * FROM halves WHERE side = 1) a LEFT JOIN (SELECT * FROM halves WHERE side = 0) b USING (event, game))"""


def roll_columns(events: DataFrame) -> DataFrame:
    """Dice: a session is a user's half of a month, a face comes from the event's properties."""
    k = F.get_json_object("props", "$.k").cast("int")
    half = F.when(F.dayofmonth("ts") <= 15, "a").otherwise("b")
    return events.select(F.concat_ws("-", F.col("user_id").cast("string"), half).alias("session"), "ts", "event_id", (k % 6 + 1).alias("face"))


def rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll_columns(table(spark, sf_dir, "events"))


ROLLS_SQL = """rolls AS (SELECT concat_ws('-', CAST(user_id AS VARCHAR), CASE WHEN day(ts) <= 15 THEN 'a' ELSE 'b' END) AS session, ts, event_id, CAST(json_extract_string(props, '$.k') AS INT) % 6 + 1 AS face FROM events)"""
