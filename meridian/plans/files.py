"""Queries that read files of other formats, written from the test tables into the shared folder, and cards, rules and labels in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import markdown, rules
from meridian.plans.registry import query
from meridian.sources import catalogues, missions as cards, tournaments
from meridian.sources.views import table
from meridian.streaming.dice import shared_folder


def _csv(rows: DataFrame) -> DataFrame:
    """rows written as CSV with a header in each file, and the lines of the files."""
    at = shared_folder(rows.sparkSession, "csv")
    rows.write.option("header", True).option("escape", '"').csv(at)
    return tournaments.file_lines(rows.sparkSession, at, "*.csv")


def _dealt(rows: DataFrame, size: int = 20_000) -> DataFrame:
    """rows in as many parts as give files of about size rows: an XML file is read by one task, so files stay small as the table grows."""
    return rows.repartition(max(1, -(-rows.count() // size)), rows.columns[0])


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


ENTRANTS = """SELECT CAST(c_custkey AS INT) AS placement, 'Ann "' || c_name || '", jr' AS player, c_mktsegment AS faction, CAST(c_custkey % 7 AS INT) AS wins, CAST({points} AS INT) AS points FROM customer WHERE c_custkey % 10 > 0"""


def _entrants(spark: SparkSession, d: str, names: dict[str, str]) -> DataFrame:
    """Each tenth row has no whole number for its place; some places have letters after them."""
    k = F.col("c_custkey")
    place = F.when(k % 10 == 0, "dropped").when(k % 3 == 0, _text(k.cast("string"), "th")).otherwise(k.cast("string"))
    at = {"place": place, "player": _text('Ann "', F.col("c_name"), '", jr'), "faction": _text(" ", F.col("c_mktsegment"), " "), "wins": (k % 7).cast("string"), "vp": (k % 90).cast("string"), "cp": F.when(k % 2 == 0, (k % 40).cast("string")).otherwise("none")}
    return table(spark, d, "customer").select(*(at[c].alias(name) for c, name in names.items()))


@query("csv_site_a", ENTRANTS.format(points="c_custkey % 90"))
def csv_site_a(spark: SparkSession, d: str) -> DataFrame:
    files = _csv(_entrants(spark, d, {"place": "Place", "player": "Player Name", "faction": " ARMY", "wins": "W", "vp": "Total VP"}))
    return tournaments.FORMATS["site_a"](files).select("placement", "player", "faction", "wins", "points")


@query("csv_site_b", ENTRANTS.format(points="CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 40 ELSE 0 END"))
def csv_site_b(spark: SparkSession, d: str) -> DataFrame:
    files = _csv(_entrants(spark, d, {"vp": "VP", "cp": "CP", "place": "Position", "player": "player", "faction": "Faction", "wins": "Wins"}))
    return tournaments.FORMATS["site_b"](files).select("placement", "player", "faction", "wins", "points")


@query("csv_generic", """WITH r AS (SELECT l_orderkey, l_returnflag, l_partkey, l_quantity, CAST(l_linenumber % 3 + 1 AS INT) AS placement, 'P' || l_suppkey || ', "' || l_linenumber || '"' AS player, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem WHERE l_orderkey % 5 > 0)
SELECT 'Open ' || l_orderkey AS event, placement, l_returnflag AS faction, arg_min(player, seq) AS player, CAST(count(*) AS INT) AS n_units, CAST(sum(l_quantity) AS DOUBLE) AS unit_points, CAST(sum(l_partkey % 9) AS INT) AS unit_games FROM r GROUP BY 1, 2, 3""")
def csv_generic(spark: SparkSession, d: str) -> DataFrame:
    """Many events in a file; one without a date is left out. The first row of a player counts, each of the rows gives a unit."""
    rows = table(spark, d, "lineitem").repartition("l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    n = F.col("l_linenumber")
    rows = rows.select(
        _text("Open ", F.col("l_orderkey").cast("string")).alias("Event Name"), F.when(F.col("l_orderkey") % 5 > 0, "2024-05-01").alias("Date"), (n % 3 + 1).cast("string").alias("Placement"),
        _text("P", F.col("l_suppkey").cast("string"), ', "', n.cast("string"), '"').alias("player_name"), F.col("l_returnflag").alias("faction"), F.col("l_partkey").cast("string").alias("bsdata_id"),
        _text("unit ", F.col("l_partkey").cast("string")).alias("unit"), (F.col("l_partkey") % 9).cast("string").alias("games played"), F.col("l_quantity").cast("string").alias("avg_points"),
    )
    units = lambda c: F.aggregate(F.transform("units", lambda u: u[c].cast("double")), F.lit(0.0), lambda a, x: a + x)
    return tournaments.FORMATS["generic"](_csv(rows)).select("event", "placement", "faction", "player", F.size("units").alias("n_units"), units("points").alias("unit_points"), units("games").cast("int").alias("unit_games"))


def _arrays(spark: SparkSession, d: str) -> str:
    """A file of one JSON array for each brand; those of some brands hold an object, or break off."""
    at, rows = shared_folder(spark, "json"), table(spark, d, "part").groupBy("p_brand").agg(F.to_json(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))).alias("value"))
    last = F.right("p_brand", F.lit(1))
    value = F.when(last == "1", _text('{"rows": ', F.col("value"), "}")).when(last == "2", F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    rows.select(F.regexp_extract("p_brand", r"\d+$", 0).alias("number"), value.alias("value")).write.partitionBy("number").text(at)
    return at


@query("json_arrays", "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size FROM part WHERE right(p_brand, 1) NOT IN ('1', '2')")
def json_arrays(spark: SparkSession, d: str) -> DataFrame:
    return tournaments.json_rows(spark, _arrays(spark, d), "struct<p_partkey:long,p_name:string,p_size:long>").select("p_partkey", "p_name", "p_size")


@query("json_unread", "SELECT DISTINCT regexp_extract(p_brand, '[0-9]+$') AS brand, CASE WHEN right(p_brand, 1) = '1' THEN 'no array' ELSE 'broken' END AS reason FROM part WHERE right(p_brand, 1) IN ('1', '2')")
def json_unread(spark: SparkSession, d: str) -> DataFrame:
    return tournaments.json_unread(spark, _arrays(spark, d)).select(F.regexp_extract("file", "number=([0-9]+)/", 1).alias("brand"), "reason")


@query("xml_units", """SELECT 'u' || p_partkey AS id, p_name AS name, CAST(p_size % 9 AS INT) AS toughness, CAST(p_size % 5 + 2 AS INT) AS save, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS points, CAST(p_partkey % 3 AS INT) AS n_weapons,
  CAST(CASE p_partkey % 4 WHEN 1 THEN 4 WHEN 2 THEN 5 END AS INT) AS invuln, CAST(CASE WHEN p_partkey % 4 = 3 THEN 6 END AS INT) AS fnp, CASE WHEN p_partkey % 3 > 0 THEN 'w' || p_size END AS weapon,
  concat_ws(',', CASE WHEN p_size % 9 = 0 THEN 'no toughness' END, CASE WHEN p_partkey % 3 = 0 THEN 'no weapons' END, CASE WHEN p_partkey % 3 > 0 AND p_size % 7 = 0 THEN 'weapon without strength' END) AS warnings FROM part WHERE p_partkey % 11 > 0""")
def xml_units(spark: SparkSession, d: str) -> DataFrame:
    """Catalogues of units with one profile, up to two weapons (each given twice) and an ability; each eleventh entry is no unit."""
    k, size = F.col("p_partkey"), F.col("p_size")
    trait = lambda name, value: F.struct(F.lit(name).alias("_name"), value.cast("string").alias("_VALUE"))
    profile = lambda name, kind, *traits: F.struct(name.alias("_name"), F.lit(kind).alias("_typeName"), F.struct(F.array(*traits).alias("characteristic")).alias("characteristics"))
    weapon = lambda letter: profile(_text(letter, size.cast("string")), "Melee Weapons", trait("A", F.lit("2")), trait("S", size % 7), trait("D", F.lit("D6")))
    told = F.when(k % 4 == 1, "This model has a 4+ invulnerable save.").when(k % 4 == 2, "It has an invulnerable save of 5+ in melee.").when(k % 4 == 3, "Feel No Pain 6+").otherwise("None")
    first = F.array(profile(F.col("p_name"), "Unit", trait("M", F.lit('6"')), trait("T", size % 9), trait("SV", _text((size % 5 + 2).cast("string"), "+"))), profile(F.lit("rule"), "Abilities", trait("Description", told)))
    arms = F.when(k % 3 == 0, F.slice(F.array(weapon("w")), 1, 0)).when(k % 3 == 1, F.array(weapon("w"), weapon("w"))).otherwise(F.array(weapon("w"), weapon("x"), weapon("w")))
    cost = F.struct(F.lit("pts").alias("_name"), F.col("p_retailprice").cast("double").alias("_value"))
    rows = table(spark, d, "part").select(_text("u", k.cast("string")).alias("_id"), F.col("p_name").alias("_name"), F.when(k % 11 == 0, "upgrade").otherwise("unit").alias("_type"), F.struct(F.concat(first, arms).alias("profile")).alias("profiles"), F.struct(F.array(cost).alias("cost")).alias("costs"))
    at = shared_folder(spark, "xml")
    _dealt(rows).write.format("xml").option("rootTag", "catalogue").option("rowTag", "selectionEntry").save(at)
    return catalogues.units(spark, at, "part-*").select("id", "name", "toughness", "save", "points", F.size("weapons").alias("n_weapons"), "invuln", "fnp", F.get("weapons", F.lit(0))["name"].alias("weapon"), F.array_join("warnings", ",").alias("warnings"))


@query("xml_unread", """SELECT '<selectionEntry id="u' || p_partkey || CASE WHEN p_partkey % 7 = 0 THEN '" name=' || p_size || ' type="unit"/>' ELSE '" type="unit"><costs></selectionEntry>' END AS entry FROM part WHERE p_partkey % 7 IN (0, 1)""")
def xml_unread(spark: SparkSession, d: str) -> DataFrame:
    """Of each seven entries one has an attribute without quotes, and one a tag that isn't closed."""
    k = F.col("p_partkey")
    rest = F.when(k % 7 == 0, _text('" name=', F.col("p_size").cast("string"), ' type="unit"/>')).when(k % 7 == 1, '" type="unit"><costs></selectionEntry>').otherwise('" type="unit"></selectionEntry>')
    at = shared_folder(spark, "xml")
    _dealt(table(spark, d, "part").select(_text('<selectionEntry id="u', k.cast("string"), rest))).write.text(at)
    return catalogues.unread_entries(spark, at, "part-*").select("entry")


@query("mission_cards", """WITH n AS (SELECT n_nationkey AS k, array_to_string(list_transform(string_split(lower(translate(n_name, '_0123456789', ' ABCDEFGHIJ')), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS name, count(*) OVER () AS total FROM nation), c AS (SELECT * FROM (VALUES (0, 'primary'), (1, 'secondary'), (2, 'deployment_zone'), (3, 'twist'), (4, 'challenger')) AS c(deck, kind))
SELECT 'mission-' || (deck * total + row_number() OVER (PARTITION BY deck ORDER BY k)) AS id, name, kind FROM n, c""")
def mission_cards(spark: SparkSession, d: str) -> DataFrame:
    """A file of cards of each kind, one line of text as it comes out of a printed page."""
    name = F.upper(F.translate("n_name", "_0123456789", " ABCDEFGHIJ"))
    lines = {
        "primary-missions.md": _text("at the end 5 VP AND 3 VP ", name, " PRIMARY MISSION when drawn. "), "secondary-missions-attacker.md": _text("AND ", name, F.when(F.col("n_nationkey") % 2 == 0, " FIXED - ").otherwise(" "), "SECONDARY MISSION.\n"),
        "deployment-zones.md": _text(name, " STRIKE FORCE. ", name, "\nINCURSION. "), "twist-cards.md": _text("FOR PLAYERS USING FIXED MISSIONS ", name, " TWIST: "),
        "challenger-cards.md": _text(name, F.when(F.col("n_nationkey") % 3 == 0, " ALL IN").when(F.col("n_nationkey") % 3 == 1, " GREAT HASTE").otherwise(""), " CHALLENGER MISSION; "), "readme.md": _text(name, " PRIMARY MISSION. "),
    }
    # A row for each nation, 25 of them.
    text = table(spark, d, "nation").agg(*(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", x.alias("x")))), lambda r: r["x"]), "").alias(at) for at, x in lines.items()))
    files = text.select(F.explode(F.create_map(*(c for at in lines for c in (F.lit(f"cards/{at}"), F.col(f"`{at}`"))))).alias("file", "value"))
    return cards.missions(files)


_HTML = {k: v.replace("'", "''") for k, v in {"ul": markdown.LIST, "p": markdown.PARAGRAPH}.items()}


@query("markdown_to_html", f"""WITH b AS (SELECT p_partkey, '<li><strong class="font-semibold text-slate-100">' || p_name || '</strong> &amp; &lt;' || p_size || '&gt;</li>' AS item, '<li><code class="px-1 py-0.5 rounded bg-slate-800 text-amber-300 text-xs font-mono">' || p_brand || '</code></li>' AS code,
  '<h2 class="text-base font-semibold text-slate-200 mt-3 mb-1">' || p_type || '</h2>' AS head, '{_HTML["p"]}<a href="u/' || p_partkey || '" class="text-amber-400 underline hover:text-amber-300" target="_blank" rel="noopener noreferrer">' || p_brand || '</a> <em>soon</em></p>' AS para, '{_HTML["ul"]}' AS ul FROM part)
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat_ws(chr(10), head, ul, item, code, '</ul>', para) WHEN 1 THEN concat_ws(chr(10), ul, item, '</ul>', head, '<br/>', ul, code, '</ul>') ELSE concat_ws(chr(10), para, '<br/>', para) END AS html FROM b""")
def markdown_to_html(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    item, code, head = _text("- **", F.col("p_name"), "** & <", F.col("p_size").cast("string"), ">"), _text("*  `", F.col("p_brand"), "`"), _text("## ", F.col("p_type"))
    para = _text("[", F.col("p_brand"), "](u/", k.cast("string"), ") *soon*")
    joined = lambda *lines: F.concat_ws("\n", *lines)
    text = F.when(k % 3 == 0, joined(head, item, code, para)).when(k % 3 == 1, joined(item, head, F.lit(" \t"), code)).otherwise(joined(para, F.lit(""), para))
    return table(spark, d, "part").select("p_partkey", markdown.markdown_to_html(text).alias("html"))


@query("pretty_json", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '{' || chr(10) || '  "name": "' || o_orderpriority || '",' || chr(10) || '  "list": [' || chr(10) || '    ' || o_custkey || ',' || chr(10) || '    1.5' || chr(10) || '  ],' || chr(10) || '  "none": []' || chr(10) || '}' WHEN 1 THEN '{"name": ' || o_custkey ELSE '"é ' || o_orderstatus || '"' END AS text FROM orders""")
def pretty_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, _text('{"name":"', F.col("o_orderpriority"), '", "list":[', F.col("o_custkey").cast("string"), '.0,1.50],"none":[ ]}')).when(k % 3 == 1, _text('{"name": ', F.col("o_custkey").cast("string"))).otherwise(_text(' "\\u00e9 ', F.col("o_orderstatus"), '"'))
    return table(spark, d, "orders").select("o_orderkey", markdown.pretty_json(raw).alias("text"))


@query("leader_rules", """WITH u AS (SELECT DISTINCT l_orderkey AS unit, l_linenumber AS seq FROM lineitem), t AS (
  SELECT unit, seq, 'REROLL_HITS_OF_1' AS type, 0 AS value FROM u WHERE seq % 4 = 1 UNION ALL SELECT unit, seq, 'REROLL_HITS', 0 FROM u WHERE seq % 4 = 1 UNION ALL SELECT unit, seq, 'SUSTAINED_HITS', seq FROM u WHERE seq % 4 = 2
  UNION ALL SELECT unit, seq, 'HIT_MOD', 1 FROM u WHERE seq % 4 = 2 UNION ALL SELECT unit, seq, 'HIT_MOD', -1 FROM u WHERE seq % 4 = 3 UNION ALL SELECT unit, seq, 'REROLL_WOUNDS', 0 FROM u WHERE seq % 4 = 3)
SELECT unit, type, CAST(value AS INT) AS value, 'a' || min(seq) AS source, CASE type WHEN 'REROLL_HITS_OF_1' THEN 'Re-roll hits of 1' WHEN 'REROLL_HITS' THEN 'Re-roll all hits' WHEN 'REROLL_WOUNDS' THEN 'Re-roll wounds' WHEN 'SUSTAINED_HITS' THEN 'Sustained Hits ' || value ELSE CASE WHEN value > 0 THEN '+1' ELSE '-1' END || ' to hit' END AS label FROM t GROUP BY unit, type, value""")
def leader_rules(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    text = F.when(n % 4 == 1, "You can re-roll hit rolls of 1.").when(n % 4 == 2, _text("Has SUSTAINED hits ", n.cast("string"), "; add 1 to the Hit roll.")).when(n % 4 == 3, "Subtract 1 to hit rolls, reroll all the wound rolls").otherwise("Nothing.")
    abilities = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), n.alias("seq"), _text("a", n.cast("string")).alias("name"), text.alias("text"))
    found = rules.leader_rules(abilities)
    return found.withColumn("label", rules.label(F.struct("type", "value", F.lit(None).cast("string").alias("keyword"))))


@query("ability_labels", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Extra Attacks' WHEN 1 THEN 'Attacks +' || p_size WHEN 2 THEN 'Anti-Vehicle ' || p_size || '+' WHEN 3 THEN 'Str -' || p_size ELSE 'PISTOL' END AS label FROM part")
def ability_labels(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey") % 5, F.col("p_size")
    kind = F.when(k < 2, "ATTACKS_MOD").when(k == 2, "ANTI").when(k == 3, "STRENGTH_MOD").otherwise("PISTOL")
    value = F.when(k == 0, 0).when(k == 3, -size).otherwise(size)
    return table(spark, d, "part").select("p_partkey", rules.label(F.struct(kind.alias("type"), value.alias("value"), F.when(k == 2, "Vehicle").alias("keyword"))).alias("label"))


_STEP = "CAST(CAST(CASE WHEN xor(h, u) >= 2147483648 THEN xor(h, u) - 4294967296 ELSE xor(h, u) END AS DOUBLE) * 16777619.0::DOUBLE AS BIGINT) & 4294967295"


@query("hash32", f"SELECT p_partkey, printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name || '-' || p_partkey, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, u: {_STEP})) AS hash FROM part")
def hash32(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", rules.hash32(F.concat_ws("-", "p_name", F.col("p_partkey").cast("string"))).alias("hash"))
