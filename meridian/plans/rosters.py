"""Queries over lists, weapons, matches, lookups and imports, each with its SQL. Where both engines read an expression alike, it is written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions import parse, text
from meridian.functions.white import WHITE, trimmed
from meridian.operators import imports, lookups, meta, rosters
from meridian.plans import folds
from meridian.plans.registry import query
from meridian.sources.views import table

UNITS = ("l_orderkey AS list", "l_partkey AS unit", "CASE WHEN l_partkey % 5 = 0 THEN 'BattleLine' END AS role", "l_partkey % 90 AS points", "CAST(l_linenumber % 3 + 1 AS BIGINT) AS count", "l_returnflag = 'R' AS warlord")
WEAPONS = ("l_orderkey AS unit", "l_linenumber * 100000 + l_partkey AS line", "concat('w', CAST(l_partkey % 50 AS VARCHAR(9))) AS name", "CASE WHEN l_suppkey % 3 = 0 THEN 'melee' ELSE '24' END AS reach", "l_suppkey % 9 = 0 AS extra", "CASE WHEN l_partkey % 20 = 0 THEN l_partkey % 40 = 0 END AS wish")
GRADED = ("p_type AS kind", "p_partkey AS unit", "CASE WHEN p_size % 6 < 5 THEN substr('SABCD', CAST(p_size % 6 AS INT) + 1, 1) END AS grade", "p_partkey % 60 AS points", "CAST(p_size % 7 AS DOUBLE) AS contribution")
TURNS = ("l_orderkey AS match", "l_linenumber AS round", "l_partkey AS seq", "CASE WHEN l_returnflag <> 'A' THEN CAST(l_quantity AS BIGINT) END AS own", "CAST(l_suppkey % 6 AS BIGINT) AS scored", "CASE WHEN l_linestatus = 'F' THEN CAST(l_linenumber % 4 AS BIGINT) END AS gained", "CASE WHEN l_partkey % 3 > 0 THEN concat('[', CASE WHEN l_partkey % 3 = 2 THEN '{\"name\":\"a\"},' ELSE '' END, '{\"name\":\"b\"}]') END AS lost")


def _select(name: str, what: tuple[str, ...], where: str = "true") -> str:
    return f"SELECT {', '.join(what)} FROM {name} WHERE {where}".replace("match,", '"match",').replace("AS match", 'AS "match"')


def _rows(spark: SparkSession, d: str, name: str, what: tuple[str, ...], where: str = "true") -> DataFrame:
    return table(spark, d, name).filter(where).selectExpr(*(x.replace("VARCHAR(9)", "STRING") for x in what))


@query("point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookups.by_key(table(spark, d, "orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey", "o_totalprice")


@query("dynamic_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 200000")
def dynamic_filter(spark: SparkSession, d: str) -> DataFrame:
    asked = {"o_orderpriority": "1-URGENT", "o_orderstatus": None, "at_least": 200000}
    terms = [F.col(c) == asked[c] if asked[c] is not None else None for c in ("o_orderpriority", "o_orderstatus")]
    return lookups.matching(table(spark, d, "orders"), [*terms, F.col("o_totalprice") >= asked["at_least"]]).select("o_orderkey", "o_totalprice")


@query("dynamic_filter_none", "SELECT c_custkey FROM customer")
def dynamic_filter_none(spark: SparkSession, d: str) -> DataFrame:
    return lookups.matching(table(spark, d, "customer"), [None]).select("c_custkey")


@query("role_gate", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'public' ELSE 'staff' END AS role FROM customer WHERE c_mktsegment = 'BUILDING'")
def role_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "public").otherwise("staff").alias("role"))
    return lookups.visible(rows, "role", "guest@example.org", ["Admin@example.org"])


@query("falsy_defaults", "SELECT p_partkey, CASE WHEN p_size % 4 IN (1, 2, 3) THEN p_size % 4 ELSE p_size END AS move, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_name END, ''), p_brand) AS title FROM part")
def falsy_defaults(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    name = F.when(size % 3 == 0, "").when(size % 3 == 1, F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", lookups.truthy(size % 4, size).alias("move"), lookups.truthy(name, F.col("p_brand")).alias("title"))


@query("named_weapons", "SELECT p_partkey, n AS name FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE p_name END AS n FROM part) WHERE n IS NOT NULL AND n NOT IN ('', '-')")
def named_weapons(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr("CASE p_size % 5 WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE p_name END")
    return lookups.named(table(spark, d, "part").select("p_partkey", name.alias("name")), "name")


#: The steps of an event.
STEPS = {"DRAFT": ["REGISTRATION"], "REGISTRATION": ["CHECK_IN"], "CHECK_IN": ["IN_PROGRESS"], "IN_PROGRESS": ["COMPLETE"]}
_STATES = "CASE o_custkey % 4 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'REGISTRATION' WHEN 2 THEN 'IN_PROGRESS' ELSE 'COMPLETE' END"
_WANTED = "CASE o_orderkey % 4 WHEN 0 THEN 'REGISTRATION' WHEN 1 THEN 'CHECK_IN' WHEN 2 THEN 'COMPLETE' END"


@query("status_transitions", f"""WITH t AS (SELECT o_orderkey, {_STATES} AS status, {_WANTED} AS wanted FROM orders),
s AS (SELECT *, coalesce((status, wanted) IN (('DRAFT', 'REGISTRATION'), ('REGISTRATION', 'CHECK_IN'), ('CHECK_IN', 'IN_PROGRESS'), ('IN_PROGRESS', 'COMPLETE')), false) AS accepted FROM t)
SELECT o_orderkey, CASE WHEN accepted THEN wanted ELSE status END AS status, accepted FROM s""")
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("o_orderkey", f"{_STATES} AS status", f"{_WANTED} AS wanted")
    return lookups.moved(rows, "status", "wanted", STEPS).drop("wanted")


@query("faction_search", "SELECT DISTINCT p_partkey AS id FROM part WHERE p_brand IN ('Brand#1', 'brand#1', 'Brand#2', 'BRAND#2') AND contains(lower(p_name), 'ring')")
def faction_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part")
    keys = F.col("p_brand").isin("Brand#1", "brand#1", "Brand#2", "BRAND#2")
    return lookups.matching(rows, [keys, F.lower("p_name").contains("ring")]).select(F.col("p_partkey").alias("id")).dropDuplicates(["id"])


@query("two_level_filter", "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#7'")
def two_level_filter(spark: SparkSession, d: str) -> DataFrame:
    return lookups.matching(table(spark, d, "part"), [F.col("p_type") == "ECONOMY", F.col("p_brand") == "Brand#7"]).select("p_partkey")


@query("rules_by_name", "SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON substr(c.c_name, 10) = substr(s.s_name, 10) WHERE c.c_mktsegment IN ('BUILDING', 'MACHINERY')")
def rules_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", F.substring("c_name", 10, 99).alias("name"))
    return a.join(table(spark, d, "supplier").select("s_suppkey", F.substring("s_name", 10, 99).alias("name")), "name").select("c_custkey", "s_suppkey")


@query("match_with_children", """SELECT o_orderkey AS id, coalesce(t.turns, '') AS turns, coalesce(s.secondaries, '') AS secondaries FROM orders
LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS turns FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) t ON t.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_partkey) AS secondaries FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) s ON s.l_orderkey = o_orderkey""")
def match_with_children(spark: SparkSession, d: str) -> DataFrame:
    """A parent with two collections of children, each aggregated before it is joined."""
    line = table(spark, d, "lineitem")
    nest = lambda rows, order, name: rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "l_partkey"))), lambda x: x.l_partkey.cast("string")), ",").alias(name))
    turns, cards = nest(line.filter("l_returnflag <> 'R'"), ["l_linenumber"], "turns"), nest(line.filter("l_returnflag = 'R'"), [], "secondaries")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(turns, "l_orderkey", "left").join(cards, "l_orderkey", "left")
    return rows.select(F.col("l_orderkey").alias("id"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("turns", "secondaries")))


@query("unit_star", """SELECT p_partkey AS unit, m.model, coalesce(m.models, 0) AS models, c.cost, coalesce(a.abilities, 0) AS abilities FROM part
LEFT JOIN (SELECT l_partkey, arg_min(l_suppkey, (l_linenumber, l_orderkey, l_suppkey)) AS model, count(*) AS models FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) m ON m.l_partkey = p_partkey
LEFT JOIN (SELECT l_partkey, arg_min(CAST(l_quantity AS BIGINT), (l_linenumber, l_orderkey, l_suppkey)) AS cost FROM lineitem GROUP BY 1) c ON c.l_partkey = p_partkey
LEFT JOIN (SELECT l_partkey, count(DISTINCT l_returnflag) AS abilities FROM lineitem GROUP BY 1) a ON a.l_partkey = p_partkey""")
def unit_star(spark: SparkSession, d: str) -> DataFrame:
    """A unit with its first model, first cost and number of abilities; all of them from one aggregation over the lines."""
    order = F.struct("l_linenumber", "l_orderkey", "l_suppkey")
    model = F.col("l_linestatus") == "F"
    line = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min_by("l_suppkey", F.when(model, order)).alias("model"), F.count_if(model).alias("models"), F.min_by(F.col("l_quantity").cast("long"), order).alias("cost"), F.count_distinct("l_returnflag").alias("abilities"))
    rows = table(spark, d, "part").join(line, "p_partkey", "left")
    return rows.select(F.col("p_partkey").alias("unit"), F.when(F.col("models") > 0, F.col("model")).alias("model"), F.coalesce("models", F.lit(0)).alias("models"), "cost", F.coalesce("abilities", F.lit(0)).alias("abilities"))


@query("faction_mapping", """SELECT n_name AS name, coalesce(CASE n_name WHEN 'NATION_3' THEN 'by hand' WHEN 'NATION_4' THEN 'other' END, k.id) AS id FROM nation
LEFT JOIN (SELECT regexp_replace(lower(concat('Nation ', CAST(s_nationkey AS VARCHAR))), '[^a-z0-9]', '', 'g') AS plain, min(s_name) AS id FROM supplier GROUP BY 1) k ON k.plain = regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g')""")
def faction_mapping(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "supplier").select(F.col("s_name").alias("id"), F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("name"))
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return lookups.mapped(table(spark, d, "nation").select(F.col("n_name").alias("name")), "name", known, {"NATION_3": "by hand", "NATION_4": "other"}, plain).select("name", "id")


@query("weapon_merge", f"""WITH a AS ({_select('lineitem', WEAPONS, 'l_linenumber <= 3')}), b AS ({_select('lineitem', WEAPONS, 'l_linenumber > 3')})
SELECT unit, line, name, false AS from_leader FROM a UNION ALL
SELECT unit, line, name, true FROM (SELECT *, row_number() OVER (PARTITION BY unit, name ORDER BY line) AS n FROM b WHERE (unit, name) NOT IN (SELECT (unit, name) FROM a)) WHERE n = 1""")
def weapon_merge(spark: SparkSession, d: str) -> DataFrame:
    own, leader = (_rows(spark, d, "lineitem", WEAPONS, w) for w in ("l_linenumber <= 3", "l_linenumber > 3"))
    return rosters.merged_weapons(own, leader).select("unit", "line", "name", "from_leader")


@query("default_weapons_melee", f"""WITH w AS ({_select('lineitem', WEAPONS)}), m AS (SELECT *, row_number() OVER (PARTITION BY unit, reach = 'melee' AND NOT extra ORDER BY line) AS place FROM w)
SELECT unit, line FROM m WHERE coalesce(wish, reach = 'melee' AND (extra OR place = 1))""")
def default_weapons_melee(spark: SparkSession, d: str) -> DataFrame:
    return rosters.chosen_weapons(_rows(spark, d, "lineitem", WEAPONS), "melee").select("unit", "line")


@query("default_weapons_ranged", f"WITH w AS ({_select('lineitem', WEAPONS)}) SELECT unit, line FROM w WHERE coalesce(wish, reach <> 'melee')")
def default_weapons_ranged(spark: SparkSession, d: str) -> DataFrame:
    return rosters.chosen_weapons(_rows(spark, d, "lineitem", WEAPONS), "ranged").select("unit", "line")


@query("profile_resolution", """SELECT p_partkey AS unit, CASE WHEN p_partkey % 2 = 0 AND p_size % 4 > 0 THEN p_size % 4 ELSE p_size END AS move, CASE WHEN p_partkey % 2 = 0 AND p_size % 3 > 0 THEN p_size % 3 ELSE 9 END AS save,
CASE WHEN p_partkey % 2 = 0 AND p_size % 3 = 2 THEN 4 ELSE 6 END AS invulnerable FROM part""")
def profile_resolution(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "part").select(F.col("p_partkey").alias("unit"), F.col("p_size").cast("long").alias("move"), F.lit(9).cast("long").alias("save"), F.lit(6).cast("long").alias("invulnerable"))
    models = table(spark, d, "part").filter("p_partkey % 2 = 0").selectExpr("p_partkey AS unit", "CAST(p_size % 4 AS BIGINT) AS move", "CAST(p_size % 3 AS BIGINT) AS save", "element_at(array('-', '–', '4+'), CAST(p_size % 3 + 1 AS INT)) AS invulnerable")
    return rosters.resolved(units, models, ["move", "save"])


@query("army_errors", f"""WITH u AS ({_select('lineitem', UNITS)})
SELECT list, 'OVER_POINTS' AS type, NULL AS unit, CAST(sum(points * count) AS BIGINT) AS value FROM u GROUP BY 1 HAVING sum(points * count) > 300
UNION ALL SELECT list, 'NO_WARLORD', NULL, 0 FROM u GROUP BY 1 HAVING NOT bool_or(warlord)
UNION ALL SELECT list, 'DUPLICATE_LIMIT', unit, CAST(sum(count) AS BIGINT) FROM u GROUP BY list, unit HAVING sum(count) > 2 AND coalesce(lower(max(role)), '') <> 'battleline'""")
def army_errors(spark: SparkSession, d: str) -> DataFrame:
    return rosters.errors(_rows(spark, d, "lineitem", UNITS), 300, 2)


@query("suggestions_by_grade", f"""WITH u AS (SELECT *, strpos('SABCD', grade) - 1 AS rank FROM ({_select('part', GRADED)}))
SELECT unit, better, CAST(place AS INT) AS place FROM (SELECT a.unit, b.unit AS better, row_number() OVER (PARTITION BY a.unit ORDER BY b.contribution DESC, b.unit) AS place
FROM u a JOIN u b ON a.kind = b.kind AND a.unit <> b.unit AND b.points > 0 AND b.points <= a.points AND b.rank < coalesce(a.rank, 999)) WHERE place <= 3""")
def suggestions_by_grade(spark: SparkSession, d: str) -> DataFrame:
    return rosters.suggestions(_rows(spark, d, "part", GRADED), ["kind"])


@query("source_preference", "SELECT p_partkey AS unit, 'second' AS source FROM part WHERE p_size > 40")
def source_preference(spark: SparkSession, d: str) -> DataFrame:
    made = lambda where, name: table(spark, d, "part").filter(where).select(F.col("p_partkey").alias("unit"), F.lit(name).alias("source"))
    return lookups.preferred(made("p_size < 0", "first"), made("p_size > 40", "second"))


@query("cost_by_line", """SELECT a.l_orderkey AS unit, a.l_linenumber AS line, min(b.cost) AS cost FROM lineitem a LEFT JOIN (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS cost FROM lineitem WHERE l_returnflag = 'N') b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1, 2""")
def cost_by_line(spark: SparkSession, d: str) -> DataFrame:
    """Each line of a unit's composition with the cost of the same line, where there is one; both sides are one aggregation."""
    cost = F.min(F.when(F.col("l_returnflag") == "N", F.col("l_quantity").cast("long")))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("line")).agg(cost.alias("cost"))


@query("end_of_game", f"""WITH t AS ({_select('lineitem', TURNS)}) SELECT "match", CAST(sum(coalesce(own, scored)) AS BIGINT) AS vp, CAST(sum(coalesce(gained, 1)) AS BIGINT) AS cp_gained, CAST(sum(coalesce(json_array_length(lost), 0)) AS BIGINT) AS lost FROM t GROUP BY 1""")
def end_of_game(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a match over its rounds: newer columns first, older ones where they are null; losses from JSON lists."""
    rows = _rows(spark, d, "lineitem", TURNS)
    return rows.groupBy("match").agg(F.sum(F.coalesce("own", "scored")).alias("vp"), F.sum(F.coalesce("gained", F.lit(1))).alias("cp_gained"), F.sum(F.coalesce(F.json_array_length("lost"), F.lit(0))).alias("lost"))


@query("stratagem_points", "SELECT o_orderkey AS match, CAST(l_linenumber AS BIGINT) AS turn, CAST(sum(l_suppkey % 3) AS BIGINT) AS cp FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2")
def stratagem_points(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter("l_returnflag = 'R'").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("o_orderkey").alias("match"), F.col("l_linenumber").cast("long").alias("turn")).agg(F.sum(F.col("l_suppkey") % 3).alias("cp"))


@query("weapon_totals", "SELECT l_orderkey AS unit, round(least(10, sum(floor(l_quantity / 7 * 100 + 0.5) / 100)), 6) AS models, round(greatest(0, 60 - sum(floor(l_quantity / 7 * 100 + 0.5) / 100)), 6) AS wounds FROM lineitem GROUP BY 1")
def weapon_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums of results rounded weapon by weapon, with what a target can lose at most and what it has left."""
    each = F.floor(F.col("l_quantity") / 7 * 100 + 0.5).cast("double") / 100
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(F.sum(each).alias("s"))
    return rows.select("unit", F.round(F.least(F.lit(10.0), "s"), 6).alias("models"), F.round(F.greatest(F.lit(0.0), 60 - F.col("s")), 6).alias("wounds"))


@query("cached_results", """SELECT l.l_partkey AS unit, count(*) AS asked, count(r.p_partkey) AS found FROM lineitem l LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 25) r ON r.p_partkey = l.l_partkey GROUP BY 1""")
def cached_results(spark: SparkSession, d: str) -> DataFrame:
    """A configuration finds the result that was kept under its own hash; the hash covers the same columns on both sides."""
    config = [F.col("unit"), F.lit("ranged").alias("attack"), F.lit(None).cast("string").alias("breakdowns")]
    asked = table(spark, d, "lineitem").select(F.col("l_partkey").alias("unit"))
    kept = lookups.cached(table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("unit"), F.col("p_size").alias("result")), spark.createDataFrame([], "config_hash string, result int"), config)
    results = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("unit"), F.col("p_size").alias("result"))
    results = kept.select("unit", "config_hash").join(results, "unit").select("config_hash", "result")
    return lookups.cached(asked, results, config).groupBy("unit").agg(F.count("*").alias("asked"), F.count("result").alias("found"))


@query("favourites_first", "SELECT c_custkey, c_name, c_mktsegment = 'BUILDING' AS favourite FROM customer ORDER BY favourite DESC, lower(c_name), c_name")
def favourites_first(spark: SparkSession, d: str) -> DataFrame:
    """A listing with favourites before others, names without regard to case, then by case."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", (F.col("c_mktsegment") == "BUILDING").alias("favourite"))
    return rows.orderBy(F.desc("favourite"), F.lower("c_name"), "c_name")


@query("legends_ids", "SELECT p_partkey AS id FROM part WHERE p_size = 50 UNION SELECT l_partkey FROM lineitem WHERE l_quantity = 50")
def legends_ids(spark: SparkSession, d: str) -> DataFrame:
    flagged = table(spark, d, "part").filter("p_size = 50").select(F.col("p_partkey").alias("id"))
    return flagged.union(table(spark, d, "lineitem").filter("l_quantity = 50").select("l_partkey")).distinct()


@query("distinct_modifiers", "SELECT l_orderkey AS unit, count(DISTINCT (l_returnflag, l_linestatus)) AS modifiers, min(l_returnflag || l_linestatus) AS least FROM lineitem GROUP BY 1")
def distinct_modifiers(spark: SparkSession, d: str) -> DataFrame:
    """Objects with equal type and value count once."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(F.collect_set(F.struct("l_returnflag", "l_linestatus")).alias("m"))
    return rows.select("unit", F.size("m").cast("long").alias("modifiers"), F.array_min(F.transform("m", lambda x: F.concat(x.l_returnflag, x.l_linestatus))).alias("least"))


_TEXT_DATES = "CASE o_orderkey % 4 WHEN 0 THEN 'soon' WHEN 1 THEN '2024-13-45' WHEN 2 THEN '' ELSE {day} END"


_ALLIED = "CASE n_nationkey % 6 WHEN 0 THEN concat('Imperium - ', n_name) WHEN 1 THEN concat('Chaos-', n_name) WHEN 2 THEN concat('Imperium', n_name) WHEN 3 THEN concat('chaos - ', n_name) WHEN 4 THEN concat(n_name, ' Chaos - x') ELSE n_name END"


@query("faction_prefix", rf"SELECT n_nationkey, regexp_replace({_ALLIED}, '^(Imperium|Chaos)\s*-\s*', '') AS faction FROM nation")
def faction_prefix(spark: SparkSession, d: str) -> DataFrame:
    """An alliance and a dash before the name go; without the dash, in small letters or further on they stay."""
    return table(spark, d, "nation").select("n_nationkey", text.faction_prefix(F.expr(_ALLIED)).alias("faction"))


@query("white_space", f"SELECT c_custkey, trim(CASE c_custkey % 4 WHEN 0 THEN chr(9) || chr(13) || chr(10) || ' ' || chr(160) || c_name WHEN 1 THEN c_name || chr(12288) || chr(65279) || ' ' || chr(8203) WHEN 2 THEN chr(8239) || chr(9) ELSE c_name || chr(9) || chr(160) || c_mktsegment END, concat({', '.join(f'chr({ord(c)})' for c in WHITE)})) AS name FROM customer")
def white_space(spark: SparkSession, d: str) -> DataFrame:
    """White space of every kind at the ends goes, within a text it stays; a zero-width space is none."""
    k, name = F.col("c_custkey") % 4, F.col("c_name")
    made = F.when(k == 0, F.concat(F.lit("\t\r\n \xa0"), name)).when(k == 1, F.concat(name, F.lit("\u3000\ufeff \u200b"))).when(k == 2, F.lit("\u202f\t")).otherwise(F.concat(name, F.lit("\t\xa0"), "c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", trimmed(made).alias("name"))


_ARMY = "CASE p_partkey % 6 WHEN 0 THEN concat('Army{n}Detachment:{n}  ', p_type, '{n}Units') WHEN 1 THEN concat('+ DETACHMENT: ', p_type, '  ') WHEN 2 THEN concat('Army{n}-- ', p_type, ' Detachment --{n}') WHEN 3 THEN concat('no detachment: ', p_type) WHEN 4 THEN concat('-- First Detachment --{n}detachment: ', p_type) ELSE 'Detachment:' END"


@query("detachment_on_next_line", "WITH t AS (SELECT p_partkey, {} AS x FROM part) SELECT p_partkey, coalesce({}) AS detachment FROM t".format(_ARMY.replace("{n}", "' || chr(10) || '"), ", ".join(f"nullif(trim(regexp_extract(x, '{p}', 1)), '')" for p in text.DETACHMENT)))
def detachment_on_next_line(spark: SparkSession, d: str) -> DataFrame:
    """Names of detachments in the lines' several forms, also on the line below; the first form goes before the second."""
    return table(spark, d, "part").select("p_partkey", text.detachment(F.expr(_ARMY.replace("{n}", r"\n"))).alias("detachment"))


@query("points_of_text", "SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN 0 ELSE p_size END AS points FROM part")
def points_of_text(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    texts = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("3 models "), size, F.lit(" PTS"))).when(F.col("p_partkey") % 3 == 1, F.concat(size, F.lit(" for all"))).otherwise("none")
    return table(spark, d, "part").select("p_partkey", parse.points(texts).alias("points"))


@query("week_of_text", f"""WITH t AS (SELECT o_orderkey, {_TEXT_DATES.format(day="strftime(o_orderdate, '%Y-%m-%d')")} AS x FROM orders)
SELECT o_orderkey, coalesce(strftime(date_trunc('week', TRY_CAST(x AS DATE)), '%Y-%m-%d'), x) AS week FROM t""")
def week_of_text(spark: SparkSession, d: str) -> DataFrame:
    """The Monday of a date in a text; what is no date stays as it is."""
    rows = table(spark, d, "orders").selectExpr("o_orderkey", _TEXT_DATES.format(day="date_format(o_orderdate, 'yyyy-MM-dd')") + " AS x")
    return rows.select("o_orderkey", meta.week(F.col("x")).alias("week"))


@query("epoch_dates", "SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%d') AS day FROM events")
def epoch_dates(spark: SparkSession, d: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", ms.alias("ms"), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd").alias("day"))


@query("joined_keys", "SELECT p_type || '::' || p_brand AS key, p_type AS a, p_brand AS b, count(*) AS n FROM part GROUP BY ALL")
def joined_keys(spark: SparkSession, d: str) -> DataFrame:
    """Text keys of two parts, split at the first mark again."""
    rows = table(spark, d, "part").groupBy(F.concat_ws("::", "p_type", "p_brand").alias("key")).agg(F.count("*").alias("n"))
    at = F.locate("::", F.col("key"))
    return rows.select("key", F.substring("key", F.lit(1), at - 1).alias("a"), F.substring("key", at + 2, F.length("key")).alias("b"), "n")


_PACKED = "CASE p_partkey % 4 WHEN 0 THEN concat('data:image/png;base64,', {b}) WHEN 1 THEN concat('data:text/plain;charset=utf-8;base64,', {b}) WHEN 2 THEN {b} END"


@query("data_urls", "SELECT p_partkey, decode(from_base64(regexp_replace({}, '^data:[^,]*;base64,', ''))) AS name FROM part".format(_PACKED.format(b="base64(encode(p_name))")))
def data_urls(spark: SparkSession, d: str) -> DataFrame:
    """Contents of data URLs of any kind, and of texts without a prefix; null stays."""
    url = F.expr(_PACKED.format(b="base64(encode(p_name, 'UTF-8'))"))
    return table(spark, d, "part").select("p_partkey", F.decode(F.unbase64(F.regexp_replace(url, r"^data:[^,]*;base64,", "")), "UTF-8").alias("name"))


@query("range_checks", "SELECT 'quantity' AS check, count(*) FILTER (NOT l_quantity BETWEEN 1 AND 40) AS violations FROM lineitem UNION ALL SELECT 'flag', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem")
def range_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rows beyond a range or an enumeration, counted by check in one pass."""
    checks = {"quantity": ~F.col("l_quantity").between(1, 40), "flag": ~F.col("l_returnflag").isin("A", "N")}
    counts = table(spark, d, "lineitem").agg(*(F.count_if(x).alias(c) for c, x in checks.items()))
    return counts.unpivot([], list(checks), "check", "violations")


@query("export_manifest", "SELECT 'nation' AS file, count(*) AS records FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def export_manifest(spark: SparkSession, d: str) -> DataFrame:
    counts = [table(spark, d, t).agg(F.lit(t).alias("file"), F.count("*").alias("records")) for t in ("nation", "orders", "part")]
    return counts[0].union(counts[1]).union(counts[2])


@query("json_export", """SELECT p_partkey, '{"id":' || p_partkey || ',"name":"' || p_name || '"}' AS record FROM part""")
def json_export(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))).alias("record"))


@query("closed_sessions", """WITH s AS (SELECT user_id, event_id, ts, min(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id) AS closed FROM events)
SELECT user_id, count(*) FILTER (closed IS NULL OR ts <= closed) AS accepted, count(*) FILTER (ts > closed) AS rejected FROM s GROUP BY 1""")
def closed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """What comes after a session's close is rejected, so its verdict stays; the close is the first of its events of that kind."""
    events = table(spark, d, "events").select("user_id", "ts", "event_type")
    ends = events.filter("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("closed"))
    rows = events.join(ends, "user_id", "left")
    return rows.groupBy("user_id").agg(F.count_if(F.expr("closed IS NULL OR ts <= closed")).alias("accepted"), F.count_if(F.expr("ts > closed")).alias("rejected"))


@query("import_without_orphans", """WITH k AS (SELECT DISTINCT l_orderkey, l_linenumber, last_value(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS part FROM lineitem)
SELECT (SELECT count(*) FROM lineitem) AS read, count(*) AS kept, (SELECT count(*) FROM lineitem) - count(*) AS dropped FROM k WHERE part IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def import_without_orphans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("seq", F.struct("l_partkey", "l_suppkey", "l_quantity"))
    parents = [("l_partkey", table(spark, d, "part").filter("p_size > 10"), "p_partkey")]
    return imports.without_orphans(rows, ["l_orderkey", "l_linenumber"], "seq", parents)[1]


_RESULTS = ("l_orderkey * 10000000 + l_partkey * 1000 + l_suppkey AS seq", "CASE WHEN l_partkey % 4 > 0 THEN concat('Supplier#', lpad(CAST(l_partkey % 300 AS VARCHAR(9)), 9, '0')) END AS player", "l_returnflag AS faction", "l_linenumber AS placement", "CAST(l_suppkey % 4 AS INT) AS wins", "CAST(l_partkey % 3 AS INT) AS losses", "0 AS draws")


@query("import_accounts", f"""WITH p AS (SELECT *, coalesce(player, '[' || faction || '@' || placement || ']') AS name FROM ({_select('lineitem', _RESULTS)})),
n AS (SELECT name, row_number() OVER (PARTITION BY lower(name) ORDER BY seq) AS n FROM p WHERE lower(name) NOT IN (SELECT lower(upper(s_name)) FROM supplier WHERE s_suppkey % 2 = 0))
SELECT name, s_suppkey AS "user" FROM n LEFT JOIN supplier ON lower(s_name) = lower(name) WHERE n = 1""")
def import_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Names of an import that have no rating yet, with the account of each."""
    supplier = table(spark, d, "supplier")
    state = supplier.filter("s_suppkey % 2 = 0").select(F.upper("s_name").alias("player"))
    return imports.new_accounts(_rows(spark, d, "lineitem", _RESULTS), state, supplier.select(F.col("s_suppkey").alias("user"), F.col("s_name").alias("user_name")))


_RATED = "SELECT upper(s_name) AS player, 1400.0 + s_suppkey % 200 AS rating, 120.0 AS deviation, 0.06 AS volatility, s_suppkey % 30 AS games, 'before' AS period FROM supplier WHERE s_suppkey % 2 = 0"


@query("import_ratings", folds.imported(_select("lineitem", _RESULTS), _RATED))
def import_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Ratings of real players after an import."""
    state = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.upper("s_name").alias("player"), (F.lit(1400.0) + F.col("s_suppkey") % 200).alias("rating"), F.lit(120.0).alias("deviation"), F.lit(0.06).alias("volatility"), (F.col("s_suppkey") % 30).alias("games"), F.lit("before").alias("period"))
    return imports.rated(_rows(spark, d, "lineitem", _RESULTS), state, "this")[0].withColumns({c: F.round(c, 8 if c == "volatility" else 6) for c in ("rating", "deviation", "volatility")})
