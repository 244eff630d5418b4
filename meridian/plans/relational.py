"""Listings, searches and nested reads over the event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.operators import dml, meta, standings
from meridian.plans.registry import query
from meridian.sources.views import ENTRIES_SQL, PAIRINGS_SQL, entries, pairings, table


@query("meta_top_lists", f"WITH {ENTRIES_SQL} SELECT event, CAST(placement AS INT) AS placement, faction, CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, CAST(draws AS BIGINT) AS draws FROM entries WHERE faction = 'NATION_11' ORDER BY placement, wins DESC, event LIMIT 20")
def meta_top_lists(spark: SparkSession, d: str) -> DataFrame:
    return meta.top_lists(entries(spark, d).filter("faction = 'NATION_11'"), 20).select("event", "placement", "faction", "wins", "losses", "draws")


@query("meta_timeline_one_faction", f"WITH {ENTRIES_SQL} SELECT strftime(date_trunc('week', event_date), '%Y-%m-%d') AS week, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(wins + losses + draws) AS BIGINT) AS games FROM entries WHERE faction = 'NATION_11' GROUP BY 1")
def meta_timeline_one_faction(spark: SparkSession, d: str) -> DataFrame:
    return meta.timeline(entries(spark, d).filter("faction = 'NATION_11'")).select("week", "wins", "games")


@query("matchup_matrix", f"""WITH {ENTRIES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY event) AS n FROM entries),
p AS (SELECT a.faction AS x, b.faction AS y FROM n a JOIN n b ON a.event = b.event AND b.placement = a.n + 1 - a.placement WHERE 2 * a.placement <= a.n AND a.faction <> b.faction),
m AS (SELECT least(x, y) AS a, greatest(x, y) AS b, round(count(*) FILTER (x < y) / count(*), 6) AS rate FROM p GROUP BY 1, 2)
SELECT a AS faction, b AS other, rate, CASE WHEN rate < 0.4 THEN 'bad' WHEN rate < 0.45 THEN 'poor' WHEN rate <= 0.55 THEN 'even' WHEN rate <= 0.6 THEN 'good' ELSE 'great' END AS colour FROM m
UNION ALL SELECT b, a, round(1 - rate, 6), CASE WHEN round(1 - rate, 6) < 0.4 THEN 'bad' WHEN round(1 - rate, 6) < 0.45 THEN 'poor' WHEN round(1 - rate, 6) <= 0.55 THEN 'even' WHEN round(1 - rate, 6) <= 0.6 THEN 'good' ELSE 'great' END FROM m""")
def matchup_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Matchups seen from both sides, with the colour of their share."""
    both = F.explode(F.array(F.struct(F.col("a").alias("faction"), F.col("b").alias("other"), F.col("a_win_rate").alias("rate")), F.struct(F.col("b").alias("faction"), F.col("a").alias("other"), F.round(1 - F.col("a_win_rate"), 6).alias("rate")))).alias("m")
    rate = F.col("rate")
    colour = F.when(rate < 0.4, "bad").when(rate < 0.45, "poor").when(rate <= 0.55, "even").when(rate <= 0.6, "good").otherwise("great")
    return meta.matchups(entries(spark, d)).select(both).select("m.*").withColumn("colour", colour)


@query("source_listing", "SELECT o_orderkey, o_orderdate, count(l_orderkey) AS players FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate <= DATE '1996-12-31' GROUP BY 1, 2 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def source_listing(spark: SparkSession, d: str) -> DataFrame:
    """The latest events of a span of dates with their number of players; the limit comes before the join."""
    latest = table(spark, d, "orders").filter("o_orderdate >= date '1995-01-01' and o_orderdate <= date '1996-12-31'").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("one"))
    return latest.join(lines, "o_orderkey", "left").groupBy("o_orderkey", "o_orderdate").agg(F.count("one").alias("players"))


@query("history_left_join", "SELECT l_orderkey, l_linenumber, l_quantity, o_orderpriority FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON l_orderkey = o_orderkey")
def history_left_join(spark: SparkSession, d: str) -> DataFrame:
    closed = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")
    return table(spark, d, "lineitem").join(closed, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "l_quantity", "o_orderpriority")


@query("recent_topk", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "event_type")


@query("active_sessions_join", "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def active_sessions_join(spark: SparkSession, d: str) -> DataFrame:
    recent = table(spark, d, "events").filter("ts > timestamp '2024-01-15 00:00:00'").select("event_id", "user_id")
    return recent.join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name")


@query("tournament_search", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus <> 'P' AND (contains(lower(o_orderpriority), 'urgent') OR contains(CAST(o_orderkey AS VARCHAR), '77')) ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def tournament_search(spark: SparkSession, d: str) -> DataFrame:
    """Events but drafts of which a column contains what was typed."""
    found = F.lower("o_orderpriority").contains("urgent") | F.col("o_orderkey").cast("string").contains("77")
    return table(spark, d, "orders").filter((F.col("o_orderstatus") != "P") & found).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderdate")


@query("my_tournaments_union", f"WITH {PAIRINGS_SQL}, mine AS (SELECT event FROM pairings WHERE p1 = 7 OR p2 = 7 UNION SELECT strftime(o_orderdate, '%Y-%m') FROM orders WHERE o_custkey = 11) SELECT event, count(*) AS games FROM pairings WHERE event IN (SELECT event FROM mine) GROUP BY 1")
def my_tournaments_union(spark: SparkSession, d: str) -> DataFrame:
    """Events that someone plays in or another runs."""
    games = pairings(spark, d)
    plays = games.select("event", F.explode(F.array("p1", "p2")).alias("player")).filter("player = 7").select("event")
    runs = table(spark, d, "orders").filter("o_custkey = 11").select(F.date_format("o_orderdate", "yyyy-MM").alias("event"))
    return games.join(plays.union(runs).distinct(), "event", "left_semi").groupBy("event").agg(F.count("*").alias("games"))


@query("round_pairings_enriched", f"WITH {PAIRINGS_SQL} SELECT event, game, coalesce(a.c_name, '') AS name1, coalesce(b.c_name, 'bye') AS name2, result FROM pairings LEFT JOIN customer a ON a.c_custkey = p1 LEFT JOIN customer b ON b.c_custkey = p2")
def round_pairings_enriched(spark: SparkSession, d: str) -> DataFrame:
    name = lambda p, c: table(spark, d, "customer").select(F.col("c_custkey").alias(p), F.col("c_name").alias(c))
    rows = pairings(spark, d).join(name("p1", "name1"), "p1", "left").join(name("p2", "name2"), "p2", "left")
    return rows.select("event", "game", F.coalesce("name1", F.lit("")).alias("name1"), F.coalesce("name2", F.lit("bye")).alias("name2"), "result")


@query("have_met", f"WITH {PAIRINGS_SQL} SELECT least(p1, p2) AS a, greatest(p1, p2) AS b, count(*) AS games FROM pairings WHERE p2 IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def have_met(spark: SparkSession, d: str) -> DataFrame:
    """Players who met more than once, whichever side they had."""
    games = pairings(spark, d).filter("p2 is not null")
    return games.groupBy(F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b")).agg(F.count("*").alias("games")).filter("games > 1")


@query("closable_rounds", f"WITH {PAIRINGS_SQL} SELECT event, count(*) FILTER (result <> 'BYE' AND vp1 % 7 = 0) AS open, count(*) FILTER (result <> 'BYE' AND vp1 % 7 = 0) = 0 AS closable FROM pairings GROUP BY 1")
def closable_rounds(spark: SparkSession, d: str) -> DataFrame:
    """A round can be closed when no game but a bye waits to be confirmed."""
    waits = F.count_if((F.col("result") != "BYE") & (F.col("vp1") % 7 == 0))
    return pairings(spark, d).groupBy("event").agg(waits.alias("open")).withColumn("closable", F.col("open") == 0)


@query("player_rollup", f"WITH {ENTRIES_SQL} SELECT detachment, count(*) AS entries, count(DISTINCT faction) AS factions, count(*) FILTER (wins > losses) AS positive FROM entries GROUP BY 1")
def player_rollup(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).groupBy("detachment").agg(F.count("*").alias("entries"), F.countDistinct("faction").alias("factions"), F.count_if(F.col("wins") > F.col("losses")).alias("positive"))


@query("placement_export", f"WITH {PAIRINGS_SQL}, s AS (SELECT event, p1 AS player, vp1 AS vp, CAST(result IN ('P1', 'BYE') AS INT) AS won FROM pairings UNION ALL SELECT event, p2, vp2, CAST(result = 'P2' AS INT) FROM pairings WHERE p2 IS NOT NULL), r AS (SELECT event, player, sum(won) AS wins FROM s GROUP BY 1, 2) SELECT event, count(*) AS players, CAST(sum(wins) AS BIGINT) AS wins FROM r GROUP BY 1")
def placement_export(spark: SparkSession, d: str) -> DataFrame:
    """A finished event as one record, its players as JSON by place, and read back."""
    placed = standings.standings(pairings(spark, d)).groupBy("event").agg(F.to_json(F.sort_array(F.collect_list(F.struct("place", "player", "wins")))).alias("players"))
    back = placed.select("event", F.from_json("players", "array<struct<place:int,player:long,wins:long>>").alias("p"))
    return back.select("event", F.size("p").cast("long").alias("players"), F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["wins"]).alias("wins"))


@query("unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark: SparkSession, d: str) -> DataFrame:
    return dml.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("partial_update", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 'X' END, o_orderstatus) AS o_orderstatus, coalesce(CASE WHEN o_orderkey % 6 = 0 THEN 'none' END, o_orderpriority) AS o_orderpriority FROM orders")
def partial_update(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    patch = rows.filter("o_orderkey % 4 = 0 or o_orderkey % 6 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 6 == 0, "none").alias("o_orderpriority"))
    return dml.patched(rows, patch, ["o_orderkey"])


@query("cascade_delete", "SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 10 <> 0")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each table after some accounts and all that hangs on them are deleted."""
    left = dml.cascade_delete(table(spark, d, "customer"), F.col("c_custkey") % 10 == 0, "c_custkey", [(table(spark, d, "orders"), "o_custkey", "o_orderkey"), (table(spark, d, "lineitem"), "l_orderkey", None)])
    counts = [x.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, x in zip(("customer", "orders", "lineitem"), left)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("cp_carry", "SELECT conv_id, turn, CAST(coalesce(sum(length(text) % 3 - length(text) % 2) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations")
def cp_carry(spark: SparkSession, d: str) -> DataFrame:
    """What a turn starts with: all that was gained and spent before it."""
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    change = (F.length("text") % 3 - F.length("text") % 2).cast("long")
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.sum(change).over(before), F.lit(0)).alias("start"))


@query("rating_range", "SELECT o_custkey, floor(min(o_totalprice)) AS low, floor(max(o_totalprice)) AS high, greatest(100.0, floor(max(o_totalprice)) - floor(min(o_totalprice))) AS span FROM orders GROUP BY 1")
def rating_range(spark: SparkSession, d: str) -> DataFrame:
    low, high = F.floor(F.min("o_totalprice")).cast("double"), F.floor(F.max("o_totalprice")).cast("double")
    return table(spark, d, "orders").groupBy("o_custkey").agg(low.alias("low"), high.alias("high")).withColumn("span", F.greatest(F.lit(100.0), F.col("high") - F.col("low")))


@query("list_export", "SELECT l_orderkey, 'Army ' || l_orderkey || chr(10) || string_agg('- ' || p_name || ' [' || p_size || ']', chr(10) ORDER BY p_name, p_size) || chr(10) || 'Total: ' || CAST(sum(p_size) AS BIGINT) AS text FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def list_export(spark: SparkSession, d: str) -> DataFrame:
    """An army list as text."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    units = F.transform(F.sort_array(F.collect_list(F.struct("p_name", "p_size"))), lambda u: F.format_string("- %s [%d]", u["p_name"], u["p_size"]))
    body = rows.groupBy("l_orderkey").agg(units.alias("units"), F.sum("p_size").alias("total"))
    return body.select("l_orderkey", F.concat_ws("\n", F.format_string("Army %d", "l_orderkey"), F.array_join("units", "\n"), F.format_string("Total: %d", "total")).alias("text"))


@query("face_distribution", "WITH f AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) % 6 + 1 AS face FROM events), n AS (SELECT user_id, count(*) AS total FROM f GROUP BY 1) SELECT user_id, face, count(f2.face) AS n, round(count(f2.face) / any_value(total), 6) AS share FROM n CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6]) AS face) LEFT JOIN f f2 USING (user_id, face) GROUP BY 1, 2")
def face_distribution(spark: SparkSession, d: str) -> DataFrame:
    """All six faces of each user, those never thrown too."""
    face = F.get_json_object("props", "$.k").cast("int") % 6 + 1
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.array(*(F.count_if(face == f) for f in range(1, 7))).alias("n"))
    rows = counts.select("user_id", "total", F.posexplode("n").alias("at", "n"))
    return rows.select("user_id", (F.col("at") + 1).alias("face"), "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
