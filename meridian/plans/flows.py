"""Queries whose rows have an order of arrival, a state or a history: sources in order, closed sessions, weeks, table changes, replays, the next round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.operators import dml, imports, lookups, quantiles, standings, swiss
from meridian.plans import folds
from meridian.plans.catalog import DICE_SQL, STANDINGS_SQL
from meridian.plans.registry import query
from meridian.plans.rosters import _RATED, _RESULTS, _rows, _select
from meridian.sinks import tables
from meridian.sources import ordered
from meridian.sources.views import PAIRINGS_SQL, ROLLS_SQL, pairings, table
from meridian.streaming import sessions, weeks
from meridian.streaming.dice import drained, in_batches, shared_folder


def _by_day(spark: SparkSession, d: str) -> DataFrame:
    """Events from a file for each day, in a file by falling value."""
    at = shared_folder(spark, "days")
    rows = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return ordered.arranged(rows, at, rows.count(), "day", F.desc("value"), "event_id")


_DAYS = "src AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value DESC, event_id) AS r FROM events)"


@query("latest_insert", f"WITH {_DAYS} SELECT user_id, event_id, event_type FROM src QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC, r DESC) = 1")
def latest_insert(spark: SparkSession, d: str) -> DataFrame:
    """Each user's row that was inserted last, whatever its other columns say."""
    return ordered.latest(_by_day(spark, d), "user_id").select("user_id", "event_id", "event_type")


@query("first_in_source_order", f"WITH {_DAYS} SELECT event_id, user_id FROM src ORDER BY day, r LIMIT 50")
def first_in_source_order(spark: SparkSession, d: str) -> DataFrame:
    return ordered.first(_by_day(spark, d), 50).select("event_id", "user_id")


@query("source_row_numbers", f"WITH {_DAYS} SELECT event_id, row_number() OVER (ORDER BY day, r) AS number FROM src")
def source_row_numbers(spark: SparkSession, d: str) -> DataFrame:
    return ordered.numbered(_by_day(spark, d)).select("event_id", "number")


@query("items_in_source_order", """WITH l AS (SELECT *, l_orderkey % 8 AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS item FROM lineitem)
SELECT l_suppkey AS supplier, l_orderkey AS "order", item FROM l QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY part, l_orderkey DESC, item) = 1""")
def items_in_source_order(spark: SparkSession, d: str) -> DataFrame:
    """The first item of each supplier in files of orders with their lines as arrays; the order of files, rows and items is kept through the shuffle."""
    at = shared_folder(spark, "lists")
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    items = table(spark, d, "lineitem")
    lists = items.groupBy(F.col("l_orderkey").alias("order")).agg(lines.alias("lines")).withColumn("part", F.col("order") % 8)
    rows = ordered.items(ordered.arranged(lists, at, items.count(), "part", F.desc("order")), "lines", "line").withColumn("supplier", F.col("line.l_suppkey"))
    return ordered.earliest(rows, "supplier").select("supplier", "order", F.col("ordinal.item").alias("item"))


_ACTION = "CASE WHEN event_type = 'error' AND event_id % 8 = 0 THEN 'close' WHEN event_id % 3 > 0 THEN 'roll' ELSE 'undo' END"
_ACTIONS = f"""acts AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, {_ACTION} AS action, CAST(json_extract_string(props, '$.k') AS INT) % 6 + 1 AS face FROM events),
live AS (SELECT acts.*, closed FROM acts LEFT JOIN (SELECT session, min(seq) AS closed FROM acts WHERE action = 'close' GROUP BY 1) USING (session)),
s AS (SELECT session, seq, CASE WHEN action = 'roll' THEN face END AS face, sum(CASE WHEN action = 'roll' THEN 1 ELSE -1 END) OVER (PARTITION BY session ORDER BY seq) AS s FROM live WHERE action <> 'close' AND (closed IS NULL OR seq < closed)),
t AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY session ORDER BY seq)) AS t FROM s),
l AS (SELECT *, min(t) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM t),
kept AS (SELECT session, seq, face FROM l WHERE face IS NOT NULL AND coalesce(later, t) >= t),
known AS (SELECT session, bool_or(action = 'close') AS closed FROM acts GROUP BY 1)"""
_VERDICTS = DICE_SQL.replace(ROLLS_SQL, _ACTIONS).replace("SELECT session, count(*) AS n", "SELECT session, any_value(closed) AS closed, count(face) AS n").replace("FROM rolls GROUP", "FROM known LEFT JOIN kept USING (session) GROUP").replace("AS loaded FROM z", "AS loaded, closed FROM z")


def _actions(spark: SparkSession, d: str) -> DataFrame:
    """Actions as a stream of four batches."""
    face = F.get_json_object("props", "$.k").cast("int") % 6 + 1
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.expr(_ACTION).alias("action"), face.alias("face"))
    most = F.lit(rows.agg(F.max("seq")).first()[0] or 0)
    return in_batches(rows, [F.ceil(F.col("seq") * 4 / (most + 1)) == k if k else F.col("seq") * 4 < 1 for k in range(5)])


@query("stream_sessions", _VERDICTS)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts over what sessions hold after rolls and take-backs; what comes after a session's close doesn't change them."""
    return sessions.outputs(_actions(spark, d))[0]


@query("stream_refusals", f"""WITH {_ACTIONS} SELECT session, seq, 'closed' AS reason FROM live WHERE action <> 'close' AND seq > closed
UNION ALL SELECT session, seq, 'nothing to take back' FROM (SELECT *, coalesce(lag(t) OVER (PARTITION BY session ORDER BY seq), 0) AS before FROM t) WHERE face IS NULL AND before = 0""")
def stream_refusals(spark: SparkSession, d: str) -> DataFrame:
    return sessions.outputs(_actions(spark, d))[1]


@query("stream_weeks", """WITH e AS (SELECT *, CAST(date_trunc('week', ts) AS DATE) AS week FROM events WHERE NOT (event_id % 40 = 7 AND ts < TIMESTAMP '2024-01-08'))
SELECT strftime(week, '%Y-%m-%d') AS week, event_type, count(*) AS n FROM e WHERE week + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""")
def stream_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Weeks that are over. Some events of the third week come a batch later, in time; some of the first one at the end, too late."""
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    late = (F.col("event_id") % 40 == 7) & (F.col("ts") < day("2024-01-08"))
    waits = (F.col("event_id") % 40 == 11) & (F.col("ts") >= day("2024-01-15"))
    batch = F.when(late, 3).when(F.col("ts") < day("2024-01-09"), 0).when((F.col("ts") < day("2024-01-16")) & ~waits, 1).when(F.col("ts") < day("2024-01-24"), 2).otherwise(3)
    stream = in_batches(table(spark, d, "events"), [batch == k for k in range(4)])
    return drained(weeks.weekly(stream, "event_type"), "append").withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query("table_changes", """SELECT * FROM (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_acctbal >= 0 THEN s_nationkey END AS nation, CASE WHEN s_acctbal < 0 THEN -s_acctbal ELSE s_acctbal END AS balance FROM supplier
UNION ALL SELECT 10000000 + c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN c_nationkey END, abs(c_acctbal) FROM customer WHERE c_custkey % 3 = 0) WHERE id % 5 <> 0""")
def table_changes(spark: SparkSession, d: str) -> DataFrame:
    """A table in files after inserts, an update that sets a null and a delete, each of them run twice."""
    made = lambda t, id, where="true": table(spark, d, t).filter(where).select(F.expr(id).alias("id"), *(F.col(f"{t[0]}_{c}").alias(a) for c, a in (("name", "name"), ("nationkey", "nation"), ("acctbal", "balance"))))
    held = tables.Table(spark, shared_folder(spark, "table"), ["id"]).create(made("supplier", "s_suppkey"))
    more = made("customer", "10000000 + c_custkey", "c_custkey % 3 = 0")
    for _ in range(2):
        held.insert("more", more)
        held.update("debts", F.col("balance") < 0, {"nation": F.lit(None), "balance": -F.col("balance")})
        held.delete("fifth", F.col("id") % 5 == 0)
    return held.read()


@query("json_manifest", "SELECT 'nation' AS \"table\", count(*) AS records FROM nation UNION ALL SELECT 'part', count(*) FROM part")
def json_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Records by table from the manifest beside exported JSON files, file by file."""
    rows = tables.exported({t: table(spark, d, t) for t in ("nation", "part")}, shared_folder(spark, "json"))
    return rows.groupBy("table").agg(F.sum("records").alias("records"))


@query("json_read_back", "SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN p_size END AS p_size, p_retailprice FROM part")
def json_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Exported rows read again, nulls among them."""
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.expr("IF(p_size > 25, p_size, NULL)").alias("p_size"), "p_retailprice")
    at = shared_folder(spark, "json")
    tables.exported({"part": rows}, at)
    return spark.read.schema(rows.schema).json(f"{at}/part")


_LOG = (*_RESULTS, "CAST(l_linenumber % 3 AS INT) AS import", "date_add(DATE'2024-01-01', CAST(20 - 5 * (l_linenumber % 3) AS INT)) AS event_date")
_LOG_SQL = _select("lineitem", (*_RESULTS, "CAST(l_linenumber % 3 AS INT) AS import", "DATE '2024-01-01' + CAST(20 - 5 * (l_linenumber % 3) AS INT) AS event_date"))
_VERSIONS = f"""WITH RECURSIVE s AS ({_RATED}), p AS (SELECT *, coalesce(player, '[' || faction || '@' || placement || ']') AS name FROM ({_LOG_SQL})),
ord AS (SELECT import, CAST(row_number() OVER (ORDER BY event_date, import) AS INT) AS version FROM (SELECT import, min(event_date) AS event_date FROM p GROUP BY 1)),
last AS (SELECT import, lower(name) AS key, name, wins AS w, losses AS l, draws AS d FROM p WHERE wins + losses + draws > 0 QUALIFY row_number() OVER (PARTITION BY import, lower(name) ORDER BY seq DESC, name DESC, wins DESC, losses DESC, draws DESC) = 1),
steps AS (SELECT last.*, version, row_number() OVER (PARTITION BY key ORDER BY version) AS step FROM last JOIN ord USING (import)),
f AS (SELECT st.key, CAST(0 AS BIGINT) AS step, CAST(0 AS INT) AS version, CAST(0 AS INT) AS import, coalesce(s.player, st.name) AS player, CAST(coalesce(s.games, 0) AS BIGINT) AS games, CAST(coalesce(s.rating, 1500) AS DOUBLE) AS r, CAST(coalesce(s.deviation, 350) AS DOUBLE) AS rd, CAST(coalesce(s.volatility, 0.06) AS DOUBLE) AS v FROM steps st LEFT JOIN s ON lower(s.player) = st.key WHERE st.step = 1
UNION ALL SELECT key, step, version, import, player, CAST(games + n AS BIGINT), r2, rd2, v2 FROM ({folds.period("SELECT st.key, st.step, st.version, st.import, f.player, f.games, st.w, st.l, st.d, f.r, f.rd, f.v FROM f JOIN steps st ON st.key = f.key AND st.step = f.step + 1")}))"""
_ROUNDED = "round({r}, 6) AS rating, round({rd}, 6) AS deviation, round({v}, 8) AS volatility"


def _log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    state = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.upper("s_name").alias("player"), (F.lit(1400.0) + F.col("s_suppkey") % 200).alias("rating"), F.lit(120.0).alias("deviation"), F.lit(0.06).alias("volatility"), (F.col("s_suppkey") % 30).alias("games"))
    return _rows(spark, d, "lineitem", _LOG), state


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, 8 if c == "volatility" else 6) for c in ("rating", "deviation", "volatility")})


@query("import_versions", f"{_VERSIONS} SELECT version, import, player, {_ROUNDED.format(r='r', rd='rd', v='v')}, games FROM f WHERE step > 0")
def import_versions(spark: SparkSession, d: str) -> DataFrame:
    """Three imports replayed in the order of their events, which isn't that of their ids."""
    return _rounded(imports.versions(*_log(spark, d)))


@query("import_restart", f"""{_VERSIONS}, z AS (SELECT key, player AS name, r, rd, v, games AS played FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY step DESC) = 1)
SELECT coalesce(s.player, z.name) AS player, {_ROUNDED.format(r='coalesce(r, rating)', rd='coalesce(rd, deviation)', v='coalesce(v, volatility)')}, coalesce(played, games) AS games FROM s FULL JOIN z ON lower(s.player) = z.key""")
def import_restart(spark: SparkSession, d: str) -> DataFrame:
    """The state after the last import, replayed from the state after the second."""
    log, state = _log(spark, d)
    second = imports.as_of(state, imports.versions(log, state), 2)
    return _rounded(imports.as_of(second, imports.versions(log, second, after=2), 3))


_NAMES = {0: "é", 1: "E", 2: "e", 3: "Ä", 4: "a", 5: "Z", 6: "b", 7: "ö"}
_NAME_SQL = f"CASE c_custkey % 8 {' '.join(f'WHEN {k} THEN {v!r}' for k, v in _NAMES.items())} END || substr(c_mktsegment, 1, 3) || CASE WHEN c_custkey % 3 = 0 THEN lower(c_name) ELSE c_name END"


@query("collated_names", f"SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_NAME_SQL} COLLATE en, c_custkey) AS place FROM customer")
def collated_names(spark: SparkSession, d: str) -> DataFrame:
    """Places of names of any case and with accents in the order of a dictionary."""
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.collate(F.expr(_NAME_SQL.replace("'", '"')), "UNICODE"), "c_custkey"))
    return table(spark, d, "customer").select("c_custkey", place.cast("long").alias("place"))


def _parts(spark: SparkSession, d: str, where: str, name: str) -> DataFrame:
    return table(spark, d, "part").filter(where).select(F.col("p_partkey").alias("unit"), F.lit(name).alias("source"))


@query("source_first_filled", "SELECT p_partkey AS unit, 'first' AS source FROM part WHERE p_size < 10")
def source_first_filled(spark: SparkSession, d: str) -> DataFrame:
    return lookups.preferred(_parts(spark, d, "p_size < 10", "first"), _parts(spark, d, "p_size > 40", "second"))


@query("source_both_empty", "SELECT p_partkey AS unit, 'x' AS source FROM part WHERE p_size < 0")
def source_both_empty(spark: SparkSession, d: str) -> DataFrame:
    nothing = lookups.nothing(spark, "unit bigint, source string")
    return lookups.preferred(nothing, lookups.preferred(_parts(spark, d, "p_size < 0", "first"), _parts(spark, d, "p_size > 1000", "second")))


@query("source_present", "SELECT 'small' AS source, count(*) FILTER (p_size < 10) > 0 AS present FROM part UNION ALL SELECT 'negative', count(*) FILTER (p_size < 0) > 0 FROM part")
def source_present(spark: SparkSession, d: str) -> DataFrame:
    """Whether sources have rows, by one row of each."""
    one = lambda where, name: lookups.present(_parts(spark, d, where, name)).select(F.lit(name).alias("source"), "present")
    return one("p_size < 10", "small").union(one("p_size < 0", "negative"))


_PLAYED = PAIRINGS_SQL.replace("pairings AS (SELECT a.event", "played AS (SELECT a.event")
_ACTIVE = f"""WITH {_PLAYED}, pairings AS (SELECT event, game, p1, vp1, CASE WHEN p2 % 7 <> 0 THEN p2 END AS p2, vp2, result FROM played WHERE p1 % 7 <> 0),
players AS (SELECT event, p1 AS player FROM played WHERE p1 % 7 <> 0 UNION SELECT event, p2 FROM played WHERE p2 % 7 <> 0),
of_results AS ({STANDINGS_SQL.replace(f"WITH {PAIRINGS_SQL},", "WITH")}), every AS (SELECT event, player, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, coalesce(draws, 0) AS draws, coalesce(margin, 0) AS margin, coalesce(sos, 0) AS sos, coalesce(vp, 0) AS vp FROM players LEFT JOIN of_results USING (event, player))
SELECT *, CAST(row_number() OVER (PARTITION BY event ORDER BY wins DESC, margin DESC, sos DESC, vp DESC, player) AS INT) AS place FROM every"""
_MISSIONS = ", ".join(f"'{m}'" for m in swiss.MISSIONS)


@query("next_round", f"""WITH drawn AS ({folds.swiss(_ACTIVE)}), n AS (SELECT strftime(o_orderdate, '%Y-%m') AS event, count(*) % 5 + 1 AS round FROM orders GROUP BY 1)
SELECT event, round, board, p1, p2, CASE WHEN p2 IS NULL THEN 'BYE' ELSE [{_MISSIONS}][1 + CAST('0x' || substr(md5('draw|' || event || '|' || round), 1, 8) AS BIGINT) % {len(swiss.MISSIONS)}] END AS mission,
  CASE WHEN p2 IS NULL THEN 0 END AS vp1, CASE WHEN p2 IS NULL THEN 0 END AS vp2, CASE WHEN p2 IS NULL THEN 'BYE' END AS result, p2 IS NULL AS confirmed FROM drawn JOIN n USING (event)""")
def next_round(spark: SparkSession, d: str) -> DataFrame:
    """The next round of every month's event without the players who have dropped out (each seventh)."""
    games = pairings(spark, d)
    players = games.select("event", F.explode(F.array("p1", "p2")).alias("player")).filter("player is not null").distinct()
    dropped = players.filter("player % 7 = 0")
    table_of = standings.standings(swiss.of_active(games, dropped), players.filter("player % 7 <> 0"))
    rounds = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("event")).agg((F.count("*") % 5).alias("round"))
    return swiss.next_round(table_of, games.select("event", "p1", "p2"), rounds, "draw")


_SHARES = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "most": 1.0}


@query("exact_percentiles", "SELECT l_returnflag AS flag, l_linenumber AS line, " + ", ".join(f"list_sort(list(l_extendedprice))[least(CAST(floor(count(*) * {p}) AS BIGINT), count(*) - 1) + 1] AS {name}" for name, p in _SHARES.items()) + " FROM lineitem GROUP BY ALL")
def exact_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Values at places of the sorted rows, from histograms that parts of the rows have added up."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"), "l_extendedprice")
    return quantiles.percentiles(quantiles.histogram(rows, ["flag", "line"], "l_extendedprice"), ["flag", "line"], "l_extendedprice", _SHARES)


_FALSY = "CASE p_partkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE p_brand END"


@query("first_value", f"SELECT p_partkey, CASE WHEN ({_FALSY}) <> '' THEN {_FALSY} ELSE p_type END AS label, CASE WHEN p_size % 3 <> 0 THEN p_size % 3 ELSE p_size END AS size FROM part")
def first_value(spark: SparkSession, d: str) -> DataFrame:
    """Defaults for what is null, empty or a number 0; the text "0" stands."""
    return table(spark, d, "part").select("p_partkey", lookups.truthy(F.expr(_FALSY), F.col("p_type")).alias("label"), lookups.truthy(F.col("p_size") % 3, F.col("p_size")).alias("size"))


@query("patched_with_nulls", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN 'new' ELSE s_name END AS name, CASE WHEN s_suppkey % 6 = 0 THEN -1 ELSE s_nationkey END AS nation FROM supplier")
def patched_with_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Each patch names the columns that it sets, some to null."""
    base = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    patch = base.filter("id % 3 < 2").select("id", F.expr("IF(id % 3 = 1, 'new', NULL)").alias("name"), F.lit(-1).alias("nation"), F.expr("IF(id % 6 = 0, array('name', 'nation'), array('name'))").alias("sets"))
    return dml.patched(base, patch, ["id"], "sets")


@query("optional_bounds", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice >= 100000 AND o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) UNION ALL SELECT -o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice <= 50000")
def optional_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Listings under optional terms: a bound of 0 and an empty list are none, and without a status the default one holds."""
    rows = table(spark, d, "orders")

    def listed(status: str | None, low: int, high: int, customers: list[int]) -> DataFrame:
        terms = [F.col("o_orderstatus") == status if status else F.col("o_orderstatus") != "P", F.col("o_totalprice") >= low if low else None, F.col("o_totalprice") <= high if high else None, F.col("o_custkey").isin(customers) if customers else None]
        return lookups.matching(rows, terms)

    return listed(None, 100_000, 0, [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]).select("o_orderkey").union(listed("P", 0, 50_000, []).select(-F.col("o_orderkey")))
