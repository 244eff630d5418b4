"""Cases of filters, joins and listings that other queries leave out: results not reported, owners, fallbacks of names, orders of exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions.numbers import to_fixed
from meridian.operators import dml, lookups, meta, quantiles, ratings, rosters, standings
from meridian.plans import folds
from meridian.plans.catalog import STANDINGS_SQL
from meridian.plans.registry import query
from meridian.sources import ordered
from meridian.sources.views import ENTRIES_SQL, PAIRINGS_SQL, ROLLS_SQL, entries, pairings, rolls, table
from meridian.streaming.dice import shared_folder

_PLAYED = PAIRINGS_SQL.replace("pairings AS (SELECT a.event", "played AS (SELECT a.event")


@query("reported_standings", STANDINGS_SQL.replace(PAIRINGS_SQL, f"{_PLAYED}, pairings AS (SELECT * FROM played WHERE game % 5 <> 0)"))
def reported_standings(spark: SparkSession, d: str) -> DataFrame:
    """Standings over the results there are: each fifth game has none yet."""
    games = pairings(spark, d).withColumn("result", F.when(F.col("game") % 5 != 0, F.col("result")))
    return standings.standings(games.filter(F.col("result").isNotNull()))


@query("owned_rows", "SELECT event_id, user_id % 3 = event_id % 3 AS found, CASE WHEN user_id % 3 = event_id % 3 THEN event_type END AS event_type FROM events")
def owned_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows asked for by id and owner: what another owns is not found, like what isn't there."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("owner"), "event_type")
    asked = table(spark, d, "events").select("event_id", (F.col("event_id") % 3).alias("asker"))
    return lookups.owned(asked, rows, {"event_id": "id", "asker": "owner"}).select("event_id", "found", "event_type")


@query("role_without_legends", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#1' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) AND p_size < 50 UNION ALL SELECT -p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) AND p_size < 50")
def role_without_legends(spark: SparkSession, d: str) -> DataFrame:
    """Units of a role, and of any role where none is chosen, without those that are legends by a flag or a keyword."""
    part, flagged = table(spark, d, "part"), table(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")).distinct()
    listed = lambda role: lookups.matching(part, [F.col("p_brand") == role if role else None, F.col("p_size") < 50]).join(flagged, "p_partkey", "left_anti")
    return listed("Brand#1").select("p_partkey").union(listed(None).select(-F.col("p_partkey")))


@query("token_lookup", """WITH s AS (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS token, o_custkey, o_orderdate FROM orders)
SELECT l.l_orderkey AS asked, c_name AS name FROM (SELECT DISTINCT l_orderkey FROM lineitem) l LEFT JOIN s ON s.token = md5(CAST(l.l_orderkey AS VARCHAR)) AND o_orderdate > TIMESTAMP '1995-01-01' LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 10 > 0""")
def token_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The account of each token whose session has not run out; a session without an account counts as none."""
    token = lambda c: F.md5(F.col(c).cast("string").cast("binary"))
    users = table(spark, d, "customer").filter("c_custkey % 10 > 0").select(F.col("c_custkey").alias("user"), F.col("c_name").alias("name"))
    kept = table(spark, d, "orders").select(token("o_orderkey").alias("token"), F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("until"))
    live = kept.filter(F.col("until") > F.lit("1995-01-01").cast("timestamp_ntz")).join(users, "user").select("token", "name")
    asked = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("asked")).distinct().withColumn("token", token("asked"))
    return asked.join(live, "token", "left").select("asked", "name")


@query("rating_names", "SELECT o_custkey AS id, coalesce(max(c_name), CAST(o_custkey AS VARCHAR)) AS name, count(*) AS games FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON c_custkey = o_custkey GROUP BY 1")
def rating_names(spark: SparkSession, d: str) -> DataFrame:
    """Rated players with their names; the id stands for one that is not known."""
    users = table(spark, d, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"), "c_name")
    rated = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("games"))
    return rated.join(users, "id", "left").select("id", F.coalesce("c_name", F.col("id").cast("string")).alias("name"), "games")


@query("filled_abilities", """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN '' WHEN l_suppkey % 7 = 0 THEN NULL ELSE 'own' END AS name FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN a.name = '' AND p_name IS NOT NULL THEN p_name ELSE a.name END AS name FROM a LEFT JOIN part ON p_partkey = l_partkey AND p_size > 20""")
def filled_abilities(spark: SparkSession, d: str) -> DataFrame:
    """An empty name is filled from the shared table where that has one; a null stays."""
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr("CASE WHEN l_suppkey % 2 = 0 THEN '' WHEN l_suppkey % 7 = 0 THEN NULL ELSE 'own' END").alias("name"))
    shared = table(spark, d, "part").filter("p_size > 20").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("shared"))
    return own.join(shared, "l_partkey", "left").withColumn("name", F.when((F.col("name") == "") & F.col("shared").isNotNull(), F.col("shared")).otherwise(F.col("name"))).drop("shared")


@query("latest_of_a_kind", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def latest_of_a_kind(spark: SparkSession, d: str) -> DataFrame:
    """A listing's default of twenty rows, newest first, of one format."""
    return table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey")


@query("sorted_export", "SELECT p_partkey, row_number() OVER (ORDER BY p_type, p_size DESC, p_partkey) AS place FROM part")
def sorted_export(spark: SparkSession, d: str) -> DataFrame:
    """Places of rows in files that were written in the order of several columns: sorted by ranges, in parallel, and read in the order of the files."""
    at = shared_folder(spark, "sorted")
    table(spark, d, "part").orderBy("p_type", F.desc("p_size"), "p_partkey").write.parquet(at)
    return ordered.numbered(ordered.stamped(spark.read.parquet(at)), "place").select("p_partkey", "place")


@query("distinct_of_a_type", "SELECT DISTINCT l_suppkey AS keyword FROM lineitem WHERE l_returnflag = 'R'")
def distinct_of_a_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("keyword")).distinct()


@query("fixed_digits", "SELECT o_orderkey, CAST(printf('%.4f', o_totalprice / 7 - 20000) AS DOUBLE) AS shown FROM orders")
def fixed_digits(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice").cast("double")
    return table(spark, d, "orders").select("o_orderkey", to_fixed(price / 7 - 20000).alias("shown"))


@query("array_totals", "SELECT l_orderkey AS id, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1 UNION ALL SELECT -o_orderkey, 0 FROM orders WHERE o_orderkey % 50 = 0")
def array_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums of arrays; of an empty one, 0."""
    lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_linenumber").cast("long")).alias("items"))
    empty = table(spark, d, "orders").filter("o_orderkey % 50 = 0").select((-F.col("o_orderkey")).alias("id"), F.array().cast("array<bigint>").alias("items"))
    return lists.unionByName(empty).select("id", F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


_COUNTS = "CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 5 END AS wins, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 4 END AS losses, CASE WHEN c_custkey % 2 > 0 THEN 1 END AS draws"
_ONE = "SELECT c_custkey AS player, CAST(coalesce(wins, 0) AS INT) AS w, CAST(coalesce(losses, 0) AS INT) AS l, CAST(coalesce(draws, 0) AS INT) AS d, 1500e0 AS r, 350e0 AS rd, 0.06e0 AS v FROM (SELECT c_custkey, {} FROM customer)".format(_COUNTS)


@query("rating_of_null_counts", f"SELECT player, round(r2, 6) AS rating, round(rd2, 6) AS deviation, round(v2, 8) AS volatility FROM ({folds.period(_ONE)})")
def rating_of_null_counts(spark: SparkSession, d: str) -> DataFrame:
    """A count that is missing is no game."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("player"), F.lit("one").alias("period"), *(F.expr(x) for x in _COUNTS.replace(" AS wins,", " AS wins|").replace(" AS losses,", " AS losses|").split("|")))
    return ratings.glicko(rows).select("player", F.round("rating", 6).alias("rating"), F.round("deviation", 6).alias("deviation"), F.round("volatility", 8).alias("volatility"))


@query("linked_accounts", "SELECT s_name AS player, CASE WHEN s_suppkey % 4 = 0 THEN 1000 + s_suppkey WHEN s_suppkey % 4 = 1 THEN NULL ELSE s_nationkey END AS \"user\" FROM supplier")
def linked_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Accounts that are set by hand, some taken away again; links of unknown players change nothing."""
    rated = table(spark, d, "supplier").select(F.col("s_name").alias("player"), F.col("s_nationkey").cast("long").alias("user"))
    links = table(spark, d, "supplier").filter("s_suppkey % 4 < 2").select(F.col("s_name").alias("player"), F.expr("IF(s_suppkey % 4 = 0, 1000 + s_suppkey, NULL)").cast("long").alias("user"), F.array(F.lit("user")).alias("sets"))
    unknown = table(spark, d, "customer").select(F.col("c_name").alias("player"), F.col("c_custkey").alias("user"), F.array(F.lit("user")).alias("sets"))
    return dml.patched(rated, links.unionByName(unknown), ["player"], "sets")


@query("first_by_source_order", "WITH l AS (SELECT *, l_orderkey % 8 AS part FROM lineitem) SELECT l_partkey, l_orderkey FROM l QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY part, l_orderkey, l_linenumber, l_suppkey) <= 2")
def first_by_source_order(spark: SparkSession, d: str) -> DataFrame:
    """The first two rows of each key in the order of the files they came from."""
    at = shared_folder(spark, "lines")
    lines = table(spark, d, "lineitem").withColumn("part", F.col("l_orderkey") % 8)
    rows = ordered.arranged(lines, at, lines.count(), "part", "l_orderkey", "l_linenumber", "l_suppkey")
    place = F.row_number().over(Window.partitionBy("l_partkey").orderBy(ordered.ORDINAL))
    return rows.withColumn("place", place).filter(F.col("place") <= 2).select("l_partkey", "l_orderkey")


@query("face_distribution", f"""WITH {ROLLS_SQL}, c AS (SELECT s.session, f.face, count(r.face) AS n FROM (SELECT DISTINCT session FROM rolls) s CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6]) AS face) f LEFT JOIN rolls r ON r.session = s.session AND r.face = f.face GROUP BY 1, 2),
p AS (SELECT *, sum(n) OVER (PARTITION BY session) AS total, 100.0 * n / sum(n) OVER (PARTITION BY session) AS pct FROM c)
SELECT session, face, n, round(pct, 6) AS share, CASE WHEN total < 6 THEN 'few' WHEN pct > 100.0 / 6 + 5 THEN 'over' WHEN pct < 100.0 / 6 - 5 THEN 'under' ELSE 'fair' END AS verdict FROM p""")
def face_distribution(spark: SparkSession, d: str) -> DataFrame:
    """All six faces of each session with their share of its rolls, also those that never came up; one pass, with a row for each session before the faces are laid out."""
    counts = rolls(spark, d).groupBy("session").agg(F.count("*").alias("total"), *(F.count_if(F.col("face") == f).alias(f"f{f}") for f in range(1, 7)))
    faces = F.explode(F.array(*(F.struct(F.lit(f).alias("face"), F.col(f"f{f}").alias("n")) for f in range(1, 7))))
    rows = counts.select("session", "total", faces.alias("x")).select("session", "total", "x.*").withColumn("pct", 100.0 * F.col("n") / F.col("total"))
    verdict = F.when(F.col("total") < 6, "few").when(F.col("pct") > 100 / 6 + 5, "over").when(F.col("pct") < 100 / 6 - 5, "under").otherwise("fair")
    return rows.select("session", "face", "n", F.round("pct", 6).alias("share"), verdict.alias("verdict"))


@query("histogram_bars", """WITH c AS (SELECT l_returnflag AS flag, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT l_returnflag AS flag, list_sort(list(l_quantity))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] AS median FROM lineitem GROUP BY 1)
SELECT flag, value, n, round(100.0 * n / sum(n) OVER (PARTITION BY flag), 6) AS share, round(100.0 * n / max(n) OVER (PARTITION BY flag), 6) AS width, value = median AS is_median FROM c JOIN m USING (flag)""")
def histogram_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars of a histogram: share of all rows, width against the longest bar, and which one holds the median."""
    counts = quantiles.histogram(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("value")), ["flag"], "value")
    median = quantiles.percentiles(counts, ["flag"], "value", {"median": 0.5})
    every = Window.partitionBy("flag")
    bars = counts.withColumns({"share": F.round(100.0 * F.col("n") / F.sum("n").over(every), 6), "width": F.round(100.0 * F.col("n") / F.max("n").over(every), 6)})
    return bars.join(median, "flag").withColumn("is_median", F.col("value") == F.col("median")).drop("median")


_BANDS = ((0.6, ">", "strong"), (0.55, ">", "good"), (0.4, "<", "weak"), (0.45, "<", "poor"))


@query("rate_bands", f"""WITH {ENTRIES_SQL}, n AS (SELECT event, placement, faction, count(*) OVER (PARTITION BY event) AS n FROM entries),
p AS (SELECT least(a.faction, b.faction) AS a, greatest(a.faction, b.faction) AS b, a.faction < b.faction AS won FROM n a JOIN n b ON a.event = b.event AND b.placement = a.n + 1 - a.placement WHERE 2 * a.placement <= a.n AND a.faction <> b.faction),
m AS (SELECT a, b, round(count(*) FILTER (won) / count(*), 6) AS rate FROM p GROUP BY 1, 2)
SELECT a, b, CASE {' '.join(f"WHEN rate {op} {x} THEN '{name}'" for x, op, name in _BANDS)} ELSE 'even' END AS band FROM m""")
def rate_bands(spark: SparkSession, d: str) -> DataFrame:
    """Matchups by how one-sided they are."""
    rate, band = F.col("a_win_rate"), F.lit("even")
    for x, op, name in reversed(_BANDS):
        band = F.when(rate > x if op == ">" else rate < x, name).otherwise(band)
    return meta.matchups(entries(spark, d)).select("a", "b", band.alias("band"))


@query("warlord_toggled", """WITH u AS (SELECT l_orderkey AS list, l_linenumber AS unit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place, l_returnflag = 'R' AS warlord FROM lineitem)
SELECT list, place, CASE WHEN list % 3 = 0 THEN place = 1 AND NOT warlord ELSE warlord END AS warlord FROM u""")
def warlord_toggled(spark: SparkSession, d: str) -> DataFrame:
    """In some lists the first unit is chosen: it leads alone, unless it did before; then none does."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    units = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("list"), place.cast("long").alias("place"), (F.col("l_returnflag") == "R").alias("warlord"))
    return rosters.toggled(units, "warlord", F.col("list") % 3 == 0, F.col("place") == 1)
