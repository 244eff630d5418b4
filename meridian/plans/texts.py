"""Queries over names, markup and numbers in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions import parse, text
from meridian.operators import resolve
from meridian.plans.registry import query
from meridian.sources.views import table


@query("html_to_text", f"SELECT page_id, coalesce({text.replaced_sql('CAST(html AS VARCHAR)', text.PLAIN)}, '') AS text FROM pages")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html").cast("string")).alias("text"))


@query("html_to_markdown", f"SELECT page_id, CASE WHEN contains(html, '<') THEN {text.replaced_sql('html', text.MARKDOWN)} ELSE html END AS text FROM pages")
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.html_to_markdown(F.col("html").cast("string")).alias("text"))


@query("detachment_extract", """WITH l AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '+ DETACHMENT: ' || p_type || '+' WHEN 1 THEN 'Detachment:' || p_type WHEN 2 THEN '-- ' || p_type || ' Detachment --' ELSE p_type END AS t, p_type FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type || '+' WHEN 3 THEN NULL ELSE p_type END AS detachment FROM l""")
def detachment_extract(spark: SparkSession, d: str) -> DataFrame:
    kind, k = F.col("p_type"), F.col("p_partkey") % 4
    lines = F.when(k == 0, F.concat(F.lit("Army\n+ DETACHMENT: "), kind, F.lit("+\n500 pts"))).when(k == 1, F.concat(F.lit("Detachment:"), kind)).when(k == 2, F.concat(F.lit("-- "), kind, F.lit(" Detachment --"))).otherwise(kind)
    return table(spark, d, "part").select("p_partkey", text.detachment(lines).alias("detachment"))


@query("name_normalise", """SELECT p_partkey, trim(regexp_replace(regexp_replace(translate(lower('  ' || p_name || '’s (' || p_brand || ')'), '‘’′`', ''''''''''), '[^a-z0-9_\\s''-]', '', 'g'), '\\s+', ' ', 'g')) AS name,
  trim(regexp_replace(p_name, '^x', '')) AS base FROM part""")
def name_normalise(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("  "), "p_name", F.lit("’s ("), "p_brand", F.lit(")"))
    bracketed = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") "))
    return table(spark, d, "part").select("p_partkey", text.unit_name(raw).alias("name"), text.base_name(bracketed).alias("base"))


@query("faction_normalise", "SELECT n_nationkey, trim(n_name) AS faction FROM nation")
def faction_normalise(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    raw = F.concat(F.when(k == 0, "Imperium ").when(k == 1, "Chaos ").when(k == 2, "Library ").otherwise(""), "n_name", F.when(k == 3, " Library").otherwise(""))
    return table(spark, d, "nation").select("n_nationkey", text.faction(raw).alias("faction"))


@query("title_case", "SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS name FROM nation")
def title_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", text.title(F.col("n_name")).alias("name"))


@query("notes_joined", "SELECT o_orderkey, concat_ws(' | ', CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END, nullif(o_orderpriority, '')) AS notes FROM orders")
def notes_joined(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", text.notes(F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")), F.col("o_orderpriority")).alias("notes"))


@query("stat_parse", "SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN 0 WHEN 3 THEN -p_size ELSE 0 END AS INT) AS stat, CASE WHEN p_partkey % 5 IN (2, 4) THEN 'melee' ELSE CAST(CASE p_partkey % 5 WHEN 3 THEN -p_size ELSE p_size END AS VARCHAR) END AS reach FROM part")
def stat_parse(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(size, F.lit("+"))).when(k == 1, F.concat(F.lit(" "), size, F.lit('"'))).when(k == 2, "-").when(k == 3, F.concat(F.lit("-"), size)).otherwise(" Melee ")
    return table(spark, d, "part").select("p_partkey", parse.stat(raw).alias("stat"), parse.reach(raw).alias("reach"))


@query("dice_notation", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (1 + p_size) / 2 WHEN 1 THEN 2 * (1 + p_size) / 2 + 3 WHEN 2 THEN CAST(p_size AS DOUBLE) ELSE 0.0 END AS mean,
  CAST(CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN p_size ELSE 0 END AS INT) AS least, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 2 * p_size + 3 WHEN 2 THEN p_size ELSE 0 END AS INT) AS most FROM part""")
def dice_notation(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("d"), size)).when(k == 1, F.concat(F.lit("2 D"), size, F.lit("+3"))).when(k == 2, size).otherwise("many")
    rows = table(spark, d, "part").select("p_partkey", parse.dice(parse.dice_text(raw)).alias("dice"))
    dice = F.col("dice")
    return rows.select("p_partkey", parse.dice_mean(dice).cast("double").alias("mean"), parse.dice_least(dice).alias("least"), parse.dice_most(dice).alias("most"))


@query("ability_parse", """SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 2 = 0 THEN 'SUSTAINED_HITS:' || p_size END, CASE WHEN p_partkey % 3 = 0 THEN 'ANTI:4:Vehicle' END, CASE WHEN p_partkey % 5 = 0 THEN 'REROLL_HITS:0' END, CASE WHEN p_partkey % 7 = 0 THEN 'PISTOL:0' END) AS abilities FROM part""")
def ability_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.concat_ws("; ", F.when(k % 2 == 0, F.concat(F.lit("[sustained hits ("), F.col("p_size").cast("string"), F.lit(")]"))), F.when(k % 3 == 0, "Anti-Vehicle 4+"), F.when(k % 5 == 0, "Re-roll all hit rolls."), F.lit("Unheard of"), F.when(k % 7 == 0, "pistol"))
    shown = F.transform(parse.abilities(raw), lambda a: F.concat_ws(":", a["type"], a["value"].cast("string"), a["keyword"]))
    return table(spark, d, "part").select("p_partkey", F.array_join(shown, ",").alias("abilities"))


@query("model_count_parse", "SELECT p_name, CAST(min(p_size) AS INT) AS models FROM part WHERE p_partkey % 3 <> 2 GROUP BY 1")
def model_count_parse(spark: SparkSession, d: str) -> DataFrame:
    """The least number of models among a unit's compositions."""
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("Champion and "), size, F.lit(" Models"))).when(k == 1, F.concat(size, F.lit(" troopers"))).otherwise("none")
    return table(spark, d, "part").select("p_name", parse.models(raw).alias("models")).filter("models is not null").groupBy("p_name").agg(F.min("models").alias("models"))


@query("cascade_match", """WITH a AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 3 WHEN 1 THEN ' (old)' WHEN 2 THEN ' - x' ELSE '' END AS name FROM part), b AS (SELECT p_name AS name, max(p_partkey) AS other FROM part WHERE p_size > 5 GROUP BY 1)
SELECT a.id, coalesce(x.other, y.other) AS other, CAST(CASE WHEN x.other IS NOT NULL THEN 1.0 WHEN y.other IS NOT NULL THEN 0.9 END AS DOUBLE) AS score FROM a LEFT JOIN b x ON x.name = a.name LEFT JOIN b y ON y.name = regexp_replace(a.name, ' \\(old\\)$', '')""")
def cascade_match(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    suffix = F.when(F.col("p_partkey") % 3 == 1, " (old)").when(F.col("p_partkey") % 3 == 2, " - x").otherwise("")
    left = part.select(F.col("p_partkey").alias("id"), F.concat("p_name", suffix).alias("name"))
    right = part.filter("p_size > 5").select(F.col("p_partkey").alias("other"), F.col("p_name").alias("name"))
    return resolve.cascade(left, right, [(lambda c: c, 1.0), (text.base_name, 0.9)], F.col("other")).select("id", "other", "score")


@query("rekey_rows", "WITH m AS (SELECT p_partkey, p_partkey + 1000000 AS new FROM part WHERE p_size < 25) SELECT l_orderkey, l_linenumber, coalesce(new, l_partkey) AS l_partkey FROM lineitem LEFT JOIN m ON l_partkey = p_partkey")
def rekey_rows(spark: SparkSession, d: str) -> DataFrame:
    mapping = table(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 1000000).alias("new"))
    return resolve.rekey(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", mapping)


@query("type_ahead", "SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) AS r FROM part WHERE contains(lower(p_name), 'red')) WHERE r <= 8")
def type_ahead(spark: SparkSession, d: str) -> DataFrame:
    """The first eight names that contain the letters typed."""
    return table(spark, d, "part").filter(F.lower("p_name").contains("red")).select("p_partkey", "p_name").orderBy("p_partkey").limit(8)


@query("pad_and_set", "SELECT l_orderkey, l_linenumber, array_to_string(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN i = l_linenumber % 5 + 1 THEN l_partkey % 16 WHEN i <= l_linenumber % 4 THEN i ELSE 0 END), ',') AS points FROM lineitem")
def pad_and_set(spark: SparkSession, d: str) -> DataFrame:
    """A score list filled up to five rounds, with one round set."""
    n = F.col("l_linenumber")
    have = F.filter(F.sequence(F.lit(1), F.lit(4)), lambda i: i <= n % 4)
    points = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.when(i == n % 5 + 1, F.col("l_partkey") % 16).otherwise(F.coalesce(F.get(have, i - 1), F.lit(0))))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(points, lambda x: x.cast("string")), ",").alias("points"))


@query("latest_by_unit", "SELECT l_partkey, arg_max(l_quantity, (o_orderdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS latest FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def latest_by_unit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("l_partkey").agg(F.max_by("l_quantity", F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")).alias("latest"))


@query("first_by_faction", "SELECT s_nationkey, s_suppkey, CAST(place AS INT) AS place FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier) WHERE place <= 3")
def first_by_faction(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return table(spark, d, "supplier").select("s_nationkey", "s_suppkey", place.alias("place")).filter("place <= 3")
