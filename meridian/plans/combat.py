"""Combat queries: parts attack the suppliers that sell them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import parse
from meridian.operators import combat
from meridian.plans.registry import query
from meridian.sources.views import table

#: Which weapons have which ability: every so manieth part.
_EVERY = {"Lethal Hits": 2, "Sustained Hits (2)": 3, "[DEVASTATING WOUNDS].": 5, "Twin-linked": 7, "Blast": 11, "Anti-Infantry 4+": 13, "Torrent": 17, "Melta 2": 6, "Heavy": 4, "Lance": 9, "re-roll hit rolls of 1": 8, "Rapid Fire 1": 10}


def attacks(spark: SparkSession, d: str) -> DataFrame:
    """A row for each part and each of its suppliers: weapon, target and their numbers."""
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("weapon"), F.col("l_suppkey").alias("target")).distinct()
    k, t = F.col("p_partkey"), F.col("target")
    shots = F.when(k % 4 == 0, "D6").when(k % 4 == 1, " 2d3 + 1").when(k % 4 == 2, "3").otherwise("D6-1")
    text = F.concat_ws(", ", *(F.when(k % n == 0, name) for name, n in _EVERY.items()))
    # Texts are read once a weapon, before the join multiplies them.
    weapons = table(spark, d, "part").select(
        k.alias("weapon"), shots.alias("attacks"), (2 + k % 5).alias("skill"), (F.col("p_size") % 12 + 1).alias("strength"), (-(k % 4)).alias("ap"),
        F.when(k % 3 == 0, "1").when(k % 3 == 1, "D3").otherwise("2").alias("damage"), parse.abilities(text).alias("abilities"),
    )
    target = {
        "toughness": t % 10 + 2, "save": t % 5 + 2, "invuln": F.when(t % 3 == 0, 4), "fnp": F.when(t % 4 == 0, 5), "wounds": t % 4 + 1, "models": t % 10 + 1,
        "keywords": F.when(t % 2 == 0, F.array(F.lit("INFANTRY"))),
    }
    return combat.weapons(weapons).join(pairs, "weapon").withColumns(target)


ATTACKS_SQL = """a AS (SELECT DISTINCT l_partkey AS weapon, l_suppkey AS target FROM lineitem),
b AS (SELECT weapon, target, weapon % 4 AS m, p_size % 12 + 1 AS s, target % 10 + 2 AS t, target % 10 + 1 AS models, target % 4 + 1 AS w,
  2 + weapon % 5 - CASE WHEN weapon % 4 = 0 THEN 1 ELSE 0 END AS skill, target % 5 + 2 + weapon % 4 AS save0 FROM a JOIN part ON p_partkey = weapon),
c AS (SELECT *, CASE m WHEN 0 THEN 3.5 WHEN 1 THEN 5.0 WHEN 2 THEN 3.0 ELSE 2.5 END AS n0, (7 - least(6, greatest(2, skill))) / 6.0 AS h0,
  CASE WHEN s >= 2 * t THEN 2 WHEN s > t THEN 3 WHEN s = t THEN 4 WHEN t < 2 * s THEN 5 ELSE 6 END - CASE WHEN weapon % 9 = 0 THEN 1 ELSE 0 END AS w0,
  least(7, save0, CASE WHEN target % 3 = 0 THEN 4 ELSE 7 END) AS sv, CASE WHEN target % 4 = 0 THEN 2 / 6.0 ELSE 0.0 END AS unhurt,
  CASE weapon % 3 WHEN 0 THEN 1.0 ELSE 2.0 END + CASE WHEN weapon % 6 = 0 THEN 2 ELSE 0 END AS dmg,
  CASE weapon % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END + CASE WHEN weapon % 6 = 0 THEN 2 ELSE 0 END AS dmax, CASE weapon % 3 WHEN 2 THEN 2 ELSE 1 END + CASE WHEN weapon % 6 = 0 THEN 2 ELSE 0 END AS dmin FROM b),
e AS (SELECT *, CASE WHEN weapon % 11 = 0 AND models >= 6 THEN greatest(n0, 3) ELSE n0 END + CASE WHEN weapon % 10 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN weapon % 8 = 0 THEN 1 / 6.0 ELSE 0.0 END AS again,
  least(least(6, greatest(2, w0)), CASE WHEN weapon % 13 = 0 AND target % 2 = 0 THEN 4 ELSE 7 END) AS wt, 1 - greatest(0, 7 - sv) / 6.0 AS through FROM c),
f AS (SELECT *, h0 * (1 + again) AS h, (1 + again) / 6.0 AS h6, (7 - wt) / 6.0 AS q0, CASE WHEN weapon % 7 = 0 THEN 1 - (7 - wt) / 6.0 ELSE 0.0 END AS again_w FROM e),
g AS (SELECT *, q0 * (1 + again_w) AS q, (1 + again_w) / 6.0 AS q6, CASE WHEN weapon % 17 = 0 THEN n ELSE n * CASE WHEN weapon % 2 = 0 THEN greatest(0, h - h6) ELSE h END + n * h6 * CASE WHEN weapon % 3 = 0 THEN 2 ELSE 0 END END AS hits,
  CASE WHEN weapon % 2 = 0 AND weapon % 17 <> 0 THEN n * h6 ELSE 0.0 END AS lethal FROM f),
x AS (SELECT *, hits * CASE WHEN weapon % 5 = 0 THEN greatest(0, q - q6) ELSE q END + lethal AS saveable, CASE WHEN weapon % 5 = 0 THEN hits * q6 ELSE 0.0 END AS mortal FROM g),
y AS (SELECT *, (saveable * through + mortal) * (1 - unhurt) * dmg AS dealt, least(n * through * (1 - unhurt) * dmax, models * w) AS best, least(through * (1 - unhurt) * dmin, models * w) AS worst FROM x)"""


@query("combat_hits", f"WITH {ATTACKS_SQL} SELECT weapon, target, round(hits, 6) AS hits, round(lethal, 6) AS lethal FROM x")
def combat_hits(spark: SparkSession, d: str) -> DataFrame:
    return combat.expected(attacks(spark, d)).select("weapon", "target", F.round("hits", 6).alias("hits"), F.round("lethal", 6).alias("lethal"))


@query("combat_wounds", f"WITH {ATTACKS_SQL} SELECT weapon, target, round(saveable, 6) AS saveable, round(mortal, 6) AS mortal FROM x")
def combat_wounds(spark: SparkSession, d: str) -> DataFrame:
    return combat.expected(attacks(spark, d)).select("weapon", "target", F.round("saveable", 6).alias("saveable"), F.round("mortal", 6).alias("mortal"))


_TIDY = ", ".join(f"round(round({x}, 9), 4) AS {name}" for x, name in (("dealt", "expected"), ("least(models, dealt / w)", "removed"), ("greatest(0, models - dealt / w)", "survivors"), ("best", "best"), ("worst", "worst")))


@query("combat_simulate", f"WITH {ATTACKS_SQL} SELECT weapon, target, {_TIDY} FROM y")
def combat_simulate(spark: SparkSession, d: str) -> DataFrame:
    rows = combat.expected(attacks(spark, d))
    return rows.select("weapon", "target", F.col("expected_wounds").alias("expected"), F.col("expected_removed").alias("removed"), "survivors", "best", "worst")


@query("monte_carlo_summary")
def monte_carlo_summary(spark: SparkSession, d: str) -> DataFrame:
    """Damage of all weapons on each target, over 5000 rounds. Random, so there is no SQL; tested against the expected values."""
    return combat.summary(combat.simulate(attacks(spark, d), ["target"], "weapon", seed=7), ["target"])
