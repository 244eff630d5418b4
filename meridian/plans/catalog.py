"""The library's queries over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators import dice, dml, meta, ratings, resolve, rosters, standings
from meridian.plans import folds
from meridian.plans.registry import query
from meridian.sources.views import ENTRIES_SQL, PAIRINGS_SQL, ROLLS_SQL, entries, pairings, rolls, table

_RATE = "round(CASE WHEN sum(wins + losses + draws) = 0 THEN 0.0 ELSE (sum(wins) + 0.5 * sum(draws)) / sum(wins + losses + draws) END, 6)"
_SUMS = "CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(losses) AS BIGINT) AS losses, CAST(sum(draws) AS BIGINT) AS draws"
_GROUPED = f"{_SUMS}, count(*) AS players, CAST(sum(wins + losses + draws) AS BIGINT) AS games, {_RATE} AS win_rate, round(count(*) / sum(count(*)) OVER (), 6) AS representation"
_FACTIONS = f"WITH {ENTRIES_SQL}, s AS (SELECT trim(faction) AS faction, {_GROUPED} FROM entries WHERE trim(faction) <> '' GROUP BY 1) SELECT * FROM s"


@query("meta_faction_stats", _FACTIONS)
def meta_faction_stats(spark: SparkSession, d: str) -> DataFrame:
    return meta.rates(entries(spark, d), ["faction"], "faction")


@query("meta_faction_stats_min_games", f"{_FACTIONS} WHERE games >= 2500")
def meta_faction_stats_min_games(spark: SparkSession, d: str) -> DataFrame:
    return meta.rates(entries(spark, d), ["faction"], "faction").filter("games >= 2500")


@query("meta_detachment_stats", f"WITH {ENTRIES_SQL} SELECT trim(faction) AS faction, trim(detachment) AS detachment, {_GROUPED} FROM entries WHERE trim(detachment) <> '' GROUP BY 1, 2")
def meta_detachment_stats(spark: SparkSession, d: str) -> DataFrame:
    return meta.rates(entries(spark, d), ["faction", "detachment"], "detachment")


@query("meta_matchups", f"""WITH {ENTRIES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY event) AS n FROM entries),
p AS (SELECT a.faction AS x, b.faction AS y FROM n a JOIN n b ON a.event = b.event AND b.placement = a.n + 1 - a.placement WHERE 2 * a.placement <= a.n AND a.faction <> b.faction)
SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) FILTER (x < y) AS a_wins, count(*) AS games, round(count(*) FILTER (x < y) / count(*), 6) AS a_win_rate FROM p GROUP BY 1, 2""")
def meta_matchups(spark: SparkSession, d: str) -> DataFrame:
    return meta.matchups(entries(spark, d))


@query("meta_timeline", f"WITH {ENTRIES_SQL} SELECT strftime(date_trunc('week', event_date), '%Y-%m-%d') AS week, trim(faction) AS faction, {_SUMS}, CAST(sum(wins + losses + draws) AS BIGINT) AS games, {_RATE} AS win_rate FROM entries WHERE trim(faction) <> '' GROUP BY 1, 2")
def meta_timeline(spark: SparkSession, d: str) -> DataFrame:
    return meta.timeline(entries(spark, d))


@query("meta_windows", "SELECT DISTINCT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS meta_window FROM orders")
def meta_windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), F.quarter("o_orderdate").cast("string")).alias("meta_window")).distinct()


@query("import_player_counts", "SELECT year(o_orderdate) AS season, count(DISTINCT o_orderkey) AS events, count(*) AS players FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def import_player_counts(spark: SparkSession, d: str) -> DataFrame:
    """Nested lengths: players per event record, summed by season."""
    nested = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size"))
    rows = table(spark, d, "orders").join(nested, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy(F.year("o_orderdate").cast("long").alias("season")).agg(F.count("*").alias("events"), F.sum("size").alias("players"))


@query("player_leaderboard_topk", "SELECT c_custkey, c_name, c_acctbal, CAST(floor(c_acctbal + 0.5) AS BIGINT) AS display FROM customer WHERE c_acctbal >= 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def player_leaderboard_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").filter("c_acctbal >= 0").select("c_custkey", "c_name", "c_acctbal", F.floor(F.col("c_acctbal") + 0.5).alias("display"))
    return rows.orderBy(F.desc("c_acctbal"), "c_custkey").limit(50)


@query("player_search_ilike", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%CUSTOMER%1_7%'")
def player_search_ilike(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter(F.col("c_name").ilike("%CUSTOMER%1_7%")).select("c_custkey", "c_name")


@query("overview_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("customer", "orders", "lineitem", "part", "supplier", "events")))
def overview_counts(spark: SparkSession, d: str) -> DataFrame:
    each = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("customer", "orders", "lineitem", "part", "supplier", "events")]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


@query("app_activity", "SELECT event_type, count(*) AS total, count(*) FILTER (ts > TIMESTAMP '2024-01-23 00:00:00') AS recent, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def app_activity(spark: SparkSession, d: str) -> DataFrame:
    recent = F.count_if(F.col("ts") > F.lit("2024-01-23 00:00:00").cast("timestamp"))
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("total"), recent.alias("recent"), F.countDistinct("user_id").alias("users"))


@query("top_factions", f"WITH {ENTRIES_SQL} SELECT faction, count(*) AS n FROM entries GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_factions(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).groupBy("faction").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "faction").limit(20)


@query("result_breakdown", f"WITH {PAIRINGS_SQL} SELECT event, count(*) FILTER (result = 'P1') AS p1, count(*) FILTER (result = 'P2') AS p2, count(*) FILTER (result = 'DRAW') AS draws, count(*) FILTER (p2 IS NULL) AS byes, count(*) AS total FROM pairings GROUP BY 1")
def result_breakdown(spark: SparkSession, d: str) -> DataFrame:
    tally = lambda r: F.count_if(F.col("result") == r)
    return pairings(spark, d).groupBy("event").agg(tally("P1").alias("p1"), tally("P2").alias("p2"), tally("DRAW").alias("draws"), F.count_if(F.col("p2").isNull()).alias("byes"), F.count("*").alias("total"))


_SIDES = f"""WITH {PAIRINGS_SQL}, sides AS (
  SELECT event, p1 AS player, p2 AS opponent, CASE WHEN result = 'BYE' THEN 0 ELSE vp1 END AS vp, CASE WHEN result = 'BYE' THEN 0 ELSE vp2 END AS against, CASE WHEN result IN ('P1', 'BYE') THEN 1 ELSE 0 END AS won, CASE WHEN result = 'DRAW' THEN 1 ELSE 0 END AS drew FROM pairings
  UNION ALL SELECT event, p2, p1, vp2, vp1, CASE WHEN result = 'P2' THEN 1 ELSE 0 END, CASE WHEN result = 'DRAW' THEN 1 ELSE 0 END FROM pairings WHERE p2 IS NOT NULL)"""
STANDINGS_SQL = f"""{_SIDES}, record AS (SELECT event, player, sum(won) AS wins, sum(1 - won - drew) AS losses, sum(drew) AS draws, sum(vp) AS vp, sum(vp - against) AS margin, count(*) AS games FROM sides GROUP BY 1, 2),
strength AS (SELECT s.event, s.player, avg(r.wins / r.games) AS sos FROM sides s JOIN record r ON r.event = s.event AND r.player = s.opponent GROUP BY 1, 2)
SELECT event, player, CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, CAST(draws AS BIGINT) AS draws, CAST(vp AS BIGINT) AS vp, CAST(margin AS BIGINT) AS margin, games, round(coalesce(sos, 0), 6) AS sos,
  CAST(row_number() OVER (PARTITION BY event ORDER BY wins DESC, margin DESC, round(coalesce(sos, 0), 6) DESC, vp DESC, player) AS INT) AS place FROM record LEFT JOIN strength USING (event, player)"""


@query("standings", STANDINGS_SQL)
def event_standings(spark: SparkSession, d: str) -> DataFrame:
    return standings.standings(pairings(spark, d))


@query("profile_totals", f"{_SIDES} SELECT player, count(*) AS games, CAST(sum(won) AS BIGINT) AS wins, CAST(sum(drew) AS BIGINT) AS draws, CAST(sum(vp) AS BIGINT) AS vp FROM sides GROUP BY 1")
def profile_totals(spark: SparkSession, d: str) -> DataFrame:
    return standings.sides(pairings(spark, d)).groupBy("player").agg(F.count("*").alias("games"), F.sum("won").alias("wins"), F.sum("drew").alias("draws"), F.sum("vp").alias("vp"))


@query("name_resolution", "SELECT upper('  ' || c_name || ' ') AS name, c_custkey AS user FROM customer UNION ALL SELECT c_name || 'x', NULL FROM customer")
def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer")
    names = people.select(F.upper(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("name")).unionAll(people.select(F.concat("c_name", F.lit("x"))))
    users = people.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.concat(F.lit("the "), "c_name").alias("display"))
    return resolve.account(names, users)


@query("id_mapping_ranked", """WITH a AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key, p_brand FROM part WHERE p_size <= 25),
b AS (SELECT p_partkey AS other, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key, p_brand AS brand FROM part WHERE p_size > 25),
m AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY coalesce(p_brand = brand, false) DESC, other NULLS LAST) AS r FROM a LEFT JOIN b USING (key)) SELECT id, other FROM m WHERE r = 1""")
def id_mapping_ranked(spark: SparkSession, d: str) -> DataFrame:
    key = resolve.normal(F.col("p_name")).alias("key")
    a = table(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("id"), key, F.col("p_brand").alias("own_brand"))
    b = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("other"), key, F.col("p_brand").alias("brand"))
    return resolve.best_match(a, b, ("own_brand", "brand"), "other").select("id", "other")


@query("unit_ratings", """WITH u AS (SELECT l_partkey AS unit, count(*) AS games, count(*) FILTER (o_orderstatus = 'F') AS wins, avg(p_size) AS avg_points FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) >= 3)
SELECT unit, games, wins, round(avg_points, 6) AS avg_points, round(wins / games, 6) AS contribution, round(wins / games / avg_points * 100, 6) AS efficiency,
  CASE WHEN wins / games >= 0.75 THEN 'S' WHEN wins / games >= 0.6 THEN 'A' WHEN wins / games >= 0.45 THEN 'B' WHEN wins / games >= 0.3 THEN 'C' ELSE 'D' END AS grade FROM u""")
def unit_ratings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return ratings.unit_ratings(rows.select(F.col("l_partkey").alias("unit"), (F.col("o_orderstatus") == "F").alias("won"), F.col("p_size").alias("points")))


DICE_SQL = f"""WITH {ROLLS_SQL}, c AS (SELECT session, count(*) AS n, {", ".join(f"count(*) FILTER (face = {f}) AS f{f}" for f in range(1, 7))} FROM rolls GROUP BY 1),
z AS (SELECT *, [{", ".join(f"round(abs((f{f} / n - 1.0 / 6) / sqrt(1.0 / 6 * (5.0 / 6) / n)), 6)" for f in range(1, 7))}] AS z, {" + ".join(f"(f{f} - n / 6) * (f{f} - n / 6) / (n / 6)" for f in range(1, 7))} AS chi FROM c)
SELECT session, n, CASE WHEN n < 30 THEN 'low' WHEN n < 60 THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN n >= 30 THEN round(list_max(z), 2) ELSE 0.0 END AS max_z,
  CAST(CASE WHEN n >= 30 THEN list_position(z, list_max(z)) ELSE 0 END AS BIGINT) AS face, CASE WHEN n >= 30 THEN round(chi, 6) ELSE 0.0 END AS chi, n >= 30 AND (list_max(z) >= 2.5 OR round(chi, 6) > 11.07) AS loaded FROM z"""


@query("dice_analysis", DICE_SQL)
def dice_analysis(spark: SparkSession, d: str) -> DataFrame:
    return dice.analysis(rolls(spark, d))


@query("dice_running_chi", f"""WITH {ROLLS_SQL}, c AS (SELECT session, event_id, count(*) OVER w AS n, {", ".join(f"count(*) FILTER (face = {f}) OVER w AS f{f}" for f in range(1, 7))} FROM rolls WINDOW w AS (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT session, event_id, n, round(({" + ".join(f"f{f} * f{f}" for f in range(1, 7))}) * 6 / n - n, 6) AS chi FROM c""")
def dice_running_chi(spark: SparkSession, d: str) -> DataFrame:
    return dice.running(rolls(spark, d))


@query("match_totals", "SELECT conv_id AS match, CAST(sum(length(text) % 16) AS BIGINT) AS points, CAST(max(turn) + 1 AS BIGINT) AS next_turn, arg_max(length(text) % 16, turn) AS last_points FROM conversations GROUP BY 1")
def match_totals(spark: SparkSession, d: str) -> DataFrame:
    score = (F.length("text") % 16).cast("long")
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("match")).agg(F.sum(score).alias("points"), (F.max("turn") + 1).alias("next_turn"), F.max_by(score, "turn").alias("last_points"))


_ARMY = "army AS (SELECT l_orderkey AS list, l_partkey AS unit, p_size AS points, p_type AS role FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _army(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("list"), F.col("l_partkey").alias("unit"), F.col("p_size").cast("long").alias("points"), F.col("p_type").alias("role"))


@query("army_points", f"WITH {_ARMY} SELECT list, count(*) AS units, CAST(sum(points) AS BIGINT) AS points, CAST(200 - sum(points) AS BIGINT) AS remaining FROM army GROUP BY 1")
def army_points(spark: SparkSession, d: str) -> DataFrame:
    return _army(spark, d).groupBy("list").agg(F.count("*").alias("units"), F.sum("points").alias("points"), (200 - F.sum("points")).alias("remaining"))


@query("army_validation", f"""WITH {_ARMY} SELECT list, 'over points' AS rule, CAST(sum(points) AS BIGINT) AS value FROM army GROUP BY 1 HAVING sum(points) > 150
UNION ALL SELECT list, 'duplicate ' || unit, count(*) FROM army GROUP BY list, unit HAVING count(*) > 1""")
def army_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = _army(spark, d)
    over = rows.groupBy("list").agg(F.sum("points").alias("value")).filter("value > 150").select("list", F.lit("over points").alias("rule"), "value")
    twice = rows.groupBy("list", "unit").agg(F.count("*").alias("value")).filter("value > 1").select("list", F.concat(F.lit("duplicate "), F.col("unit").cast("string")).alias("rule"), "value")
    return over.unionByName(twice)


@query("list_nest", f"WITH {_ARMY} SELECT list, string_agg(unit, ',' ORDER BY unit) AS units FROM army GROUP BY 1")
def list_nest(spark: SparkSession, d: str) -> DataFrame:
    return _army(spark, d).groupBy("list").agg(F.array_join(F.sort_array(F.collect_list("unit")), ",").alias("units"))


@query("upsert_lists", """SELECT o_orderkey, coalesce(n.o_custkey, b.o_custkey) AS o_custkey, coalesce(b.o_orderpriority, n.o_orderpriority) AS o_orderpriority FROM (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0) b
FULL JOIN (SELECT o_orderkey, o_custkey + 1 AS o_custkey, lower(o_orderpriority) AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0) n USING (o_orderkey)""")
def upsert_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    new = rows.filter("o_orderkey % 2 = 0").withColumns({"o_custkey": F.col("o_custkey") + 1, "o_orderpriority": F.lower("o_orderpriority")})
    return dml.upsert(rows.filter("o_orderkey % 3 <> 0"), new, ["o_orderkey"], ("o_orderpriority",))


@query("child_replace", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT l_orderkey, l_partkey, l_quantity + 1 FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber = 1 UNION ALL SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey % 5 = 0 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def child_replace(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    new = rows.filter("l_orderkey % 5 = 0 and l_linenumber = 1").select("l_orderkey", "l_partkey", (F.col("l_quantity") + 1).alias("l_quantity"))
    return dml.replace_children(rows.select("l_orderkey", "l_partkey", "l_quantity"), new, "l_orderkey")


@query("soft_delete", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '2024-01-01' END AS hidden FROM orders WHERE NOT (o_orderstatus IN ('P', 'F')) OR o_orderstatus = 'P'")
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("hidden"))
    return dml.delete_or_hide(rows, F.col("o_orderstatus").isin("P", "F"), F.col("o_orderstatus") == "P", "hidden", F.lit("2024-01-01")).select("o_orderkey", "hidden")


@query("insert_or_ignore", """WITH base AS (SELECT p_name AS name, min(p_partkey) AS id FROM part WHERE p_size < 3 GROUP BY 1) SELECT name, id FROM base
UNION ALL SELECT p_name, min(p_partkey) FROM part WHERE p_name NOT IN (SELECT name FROM base) GROUP BY 1""")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), "p_size")
    base = rows.filter("p_size < 3").groupBy("name").agg(F.min("id").alias("id"))
    return dml.insert_or_ignore(base, rows.select("name", "id"), ["name"], ["id"])


@query("fk_violations", """SELECT 'orders to large customers' AS "check", count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'lines to small parts', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)""")
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    people, parts = table(spark, d, "customer").filter("c_acctbal > 0"), table(spark, d, "part").filter("p_size < 40")
    return dml.orphans([("orders to large customers", table(spark, d, "orders"), "o_custkey", people, "c_custkey"), ("lines to small parts", table(spark, d, "lineitem"), "l_partkey", parts, "p_partkey")])


@query("coverage_report", "SELECT c_mktsegment AS segment, count(*) AS total, count(o.k) AS matched, round(100 * count(o.k) / count(*), 1) AS pct FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON k = c_custkey GROUP BY 1")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    rows = table(spark, d, "customer").join(used, F.col("k") == F.col("c_custkey"), "left")
    return rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("total"), F.count("k").alias("matched"), F.round(100 * F.count("k") / F.count("*"), 1).alias("pct"))


@query("faction_completeness", """SELECT n_name AS faction, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) > 0 AND coalesce(s.n, 0) > 3 AS complete FROM nation
LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = n_nationkey""")
def faction_completeness(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    rows = table(spark, d, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").fillna(0, ["customers", "suppliers"])
    return rows.select(F.col("n_name").alias("faction"), "customers", "suppliers", ((F.col("customers") > 0) & (F.col("suppliers") > 3)).alias("complete"))


@query("legends_anti_join", "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def legends_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").join(table(spark, d, "lineitem").filter("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


@query("cards_semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cards_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("cost_first_parseable", "SELECT p_name, arg_min(CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT), p_partkey) AS cost FROM part WHERE regexp_matches(p_brand, '[0-9]') GROUP BY 1")
def cost_first_parseable(spark: SparkSession, d: str) -> DataFrame:
    cost = F.nullif(F.regexp_extract("p_brand", "([0-9]+)", 1), F.lit("")).cast("long")
    return table(spark, d, "part").withColumn("cost", cost).filter("cost is not null").groupBy("p_name").agg(F.min_by("cost", "p_partkey").alias("cost"))


@query("haversine_sort", """WITH p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 > 0 THEN radians((s_suppkey * 37) % 180 - 90) END AS lat, radians((s_suppkey * 73) % 360 - 180) AS lon FROM supplier),
h AS (SELECT s_suppkey, pow(sin((lat - radians(51.5)) / 2), 2) + cos(lat) * cos(radians(51.5)) * pow(sin(lon / 2), 2) AS h FROM p) SELECT s_suppkey, round(3959 * 2 * atan2(sqrt(h), sqrt(1 - h)), 3) AS miles FROM h ORDER BY miles NULLS LAST, s_suppkey""")
def haversine_sort(spark: SparkSession, d: str) -> DataFrame:
    """In order of great-circle miles from a fixed place; those without coordinates come last."""
    k, home = F.col("s_suppkey"), F.radians(F.lit(51.5))
    lat, lon = F.when(k % 7 > 0, F.radians(k * 37 % 180 - 90)), F.radians(k * 73 % 360 - 180)
    h = F.pow(F.sin((lat - home) / 2), 2) + F.cos(lat) * F.cos(home) * F.pow(F.sin(lon / 2), 2)
    rows = table(spark, d, "supplier").select("s_suppkey", F.round(3959 * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h)), 3).alias("miles"))
    return rows.orderBy(F.asc_nulls_last("miles"), "s_suppkey")


@query("suggestions_better_cheaper", """SELECT unit, better, CAST(rank AS INT) AS rank FROM (SELECT a.p_partkey AS unit, b.p_partkey AS better, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_size DESC, b.p_partkey) AS rank
FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND b.p_size > a.p_size AND b.p_retailprice <= a.p_retailprice) WHERE rank <= 3""")
def suggestions_better_cheaper(spark: SparkSession, d: str) -> DataFrame:
    """Up to three larger units of the same kind that cost no more."""
    kind = F.lit(0).alias("tier"), F.lit(1).alias("under"), F.col("p_size").cast("double").alias("floor")
    rows = table(spark, d, "part").select("p_type", "p_brand", F.col("p_partkey").alias("unit"), F.col("p_retailprice").alias("cost"), F.col("p_size").alias("merit"), *kind)
    return rosters.better(rows, ["p_type", "p_brand"]).withColumnRenamed("place", "rank")


@query("elo_fold", folds.ELO)
def elo_fold(spark: SparkSession, d: str) -> DataFrame:
    """Ratings by month's pool; byes are no games."""
    score = F.when(F.col("result") == "P1", 1.0).when(F.col("result") == "P2", 0.0).otherwise(0.5)
    games = pairings(spark, d).filter("p2 is not null").select(F.col("event").alias("pool"), F.col("game").alias("seq"), "p1", "p2", score.alias("score"))
    return ratings.elo(games)
