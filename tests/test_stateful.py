"""Ratings, pairings, simulation and streams over worked examples."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridian.operators import combat, ratings, swiss
from meridian.plans.combat import attacks, monte_carlo_summary
from meridian.streaming import dice as streams

SF = "/root/testdata/sf0.001"


def test_glicko_of_the_published_example():
    got = ratings.glicko_period((1500.0, 200.0, 0.06), [(1400.0, 30.0, 1.0, 1), (1550.0, 100.0, 0.0, 1), (1700.0, 300.0, 0.0, 1)])
    assert got == pytest.approx((1464.06, 151.52, 0.05999), abs=0.01)


def test_glicko_folds_periods_in_order(spark):
    rows = [("a", "1", 2, 0, 0), ("a", "1", 1, None, 0), ("a", "2", 0, 0, 0), ("a", "3", 0, 2, 1), (None, "1", 1, 0, 0), ("b", None, 1, 0, 0)]
    got = ratings.glicko(spark.createDataFrame(rows, "player string, period string, wins int, losses int, draws int")).orderBy("period").collect()
    assert [r["period"] for r in got] == ["1", "2", "3"]
    assert got[0]["before"] == 1500 and got[0]["rating"] > 1500 and got[1]["rating"] == got[0]["rating"] and got[1]["deviation"] > got[0]["deviation"] and got[2]["delta"] < 0
    one = ratings.glicko_period(ratings.NEW_PLAYER, [(*ratings.UNKNOWN, 1.0, 3)])
    assert (got[0]["rating"], got[0]["deviation"]) == pytest.approx(one[:2])


def rounds(spark, players, met):
    standing = spark.createDataFrame([("e", p, place, w, l, 0) for place, (p, w, l) in enumerate(players, 1)], "event string, player long, place int, wins int, losses int, draws int")
    return sorted((r["board"], r["p1"], r["p2"]) for r in swiss.pair(standing, spark.createDataFrame(met, "event string, p1 long, p2 long")).collect())


def test_swiss(spark):
    assert rounds(spark, [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 0, 0)], []) == [(0, 5, None), (1, 1, 3), (2, 2, 4)]
    assert rounds(spark, [(1, 1, 0), (2, 1, 0), (3, 0, 1), (4, 0, 1)], [("e", 1, 2), ("e", 3, None)]) == [(1, 1, 2), (2, 3, 4)]
    assert rounds(spark, [(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 0)], [("e", 3, 1)]) == [(1, 1, 4), (2, 2, 3)]
    assert rounds(spark, [(1, 2, 0), (2, 2, 0), (3, 2, 0), (4, 1, 1)], []) == [(1, 1, 2), (2, 3, 4)]
    assert rounds(spark, [(1, 0, 0)], []) == [(0, 1, None)] and rounds(spark, [], []) == []


def test_simulation_agrees_with_expectation(spark):
    rows = attacks(spark, SF).filter("weapon % 5 <> 0 and weapon % 4 in (1, 2) and weapon % 10 <> 0").withColumn("models", F.lit(1000)).orderBy("weapon", "target").limit(6)
    want = {(r["weapon"], r["target"]): r["expected_wounds"] for r in combat.expected(rows).collect()}
    found = combat.simulate(rows, ["weapon", "target"], "weapon", iterations=4000, seed=1, slice_size=1500)
    got = combat.summary(found, ["weapon", "target"]).collect()
    assert all(r["iterations"] == 4000 and abs(r["mean"] - want[r["weapon"], r["target"]]) < 0.05 * want[r["weapon"], r["target"]] + 0.15 and r["p10"] <= r["median"] <= r["p90"] for r in got) and len(got) == len(want)
    again = combat.simulate(rows, ["weapon", "target"], "weapon", iterations=4000, seed=1, slice_size=1500)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in again.collect()}


def test_registered_simulation_has_the_whole_sample(spark, tmp_path):
    for t, n in (("part", 3), ("lineitem", 40)):
        spark.read.parquet(f"{SF}/{t}.parquet").orderBy(*(["p_partkey"] if t == "part" else ["l_partkey", "l_suppkey"])).limit(n).write.parquet(str(tmp_path / f"{t}.parquet"))
    got = monte_carlo_summary(spark, str(tmp_path)).collect()
    assert got and {r["iterations"] for r in got} == {5000}


def test_simulation_does_not_depend_on_partitions(spark):
    rows = attacks(spark, SF).filter("target = 1 or target = 2").orderBy("weapon", "target").limit(12)
    found = lambda df: {tuple(r) for r in combat.simulate(df, ["target"], "weapon", iterations=250, seed=3, slice_size=100).collect()}
    one = found(rows.coalesce(1))
    assert one == found(rows.repartition(5)) and sum(n for t, _, n in one if t == 1) == 250


def test_percentiles_by_position(spark):
    (r,) = combat.summary(spark.createDataFrame([(1, i, 1) for i in range(100)], "k int, damage long, n long"), ["k"]).collect()
    assert (r["p10"], r["median"], r["p90"], r["mean"]) == (10, 50, 90, 49.5)


def test_settled_counts(spark, tmp_path):
    found = [0, 3, 3, 3, 3, 3, 0, 0, 2, 2, 2, 0, 1]
    for part, rows in enumerate((found[:4], found[4:])):
        pd.DataFrame({"session": "s", "seq": range(part * 4, part * 4 + len(rows)), "found": rows}).to_parquet(tmp_path / f"{part}.parquet")
    frames = spark.readStream.schema("session string, seq long, found long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    assert [tuple(r) for r in streams.drained(streams.settled(frames, last=2, empty=2), "append").orderBy("seq").collect()] == [("s", 3, 3), ("s", 10, 2)]


def test_rounds_follow_the_exact_law_of_their_total(spark):
    """Two dice of attacks, lethal and sustained hits, mortal wounds, damage that may be ignored and a cap: each against all of its outcomes."""
    number = {"hit": 0.5, "hit_six": 1 / 6, "wound": 0.5, "wound_six": 1 / 6, "through": 2 / 3, "unhurt": 1 / 3, "sustained_hits": 1, "melta": 1, "attacks_mod": 0, "models": 2, "wounds": 2, "blast": 0, "torrent": 0, "lethal_hits": 1, "devastating_wounds": 1}
    c = {k: np.array([v]) for k, v in number.items()}
    attacks, hurts = ([combat._attacks(1, 2, 0, 0, 0)], np.zeros(1, int)), ([combat._hurts(1, 2, 0, 1)], np.zeros(1, int))
    one = {0: 1.0}
    both = lambda a, b: {s: sum(p * q for x, p in a.items() for y, q in b.items() if x + y == s) for s in {x + y for x in a for y in b}}
    mixed = lambda *parts: {s: sum(w * law.get(s, 0) for w, law in parts) for s in {s for _, law in parts for s in law}}
    point = {0: 1 / 3, 1: 2 / 3}
    hurt = mixed((1 / 3, one), (1 / 3, both(point, point)), (1 / 3, both(point, both(point, point))))
    hit = mixed((0.5, one), (1 / 3, hurt), (1 / 6, point))
    attack = mixed((0.5, one), (1 / 3, hit), (1 / 6, both(hurt, hit)))
    law = mixed((0.5, attack), (0.5, both(attack, attack)))
    want = [sum(p for s, p in law.items() if min(s, 4) == k) for k in range(5)]
    assert combat._laws(c, attacks, hurts, 16)[0] == pytest.approx(want, abs=1e-12)
    group, low, laws = combat._added(np.zeros(5, int), np.zeros(5, int), np.tile(want, (5, 1)))
    five = np.array([1.0])
    for _ in range(5):
        five = np.convolve(five, want)
    assert list(group) == [0] and low[0] == 0 and laws[0] == pytest.approx(five, abs=1e-12)


def test_many_weapons_cost_no_throws(spark):
    """40,000 weapons on one target, whose sum goes on through several batches, in rounds whose dice would take minutes to throw."""
    rows = attacks(spark, SF).filter("weapon = 1").limit(1).drop("weapon", "target").withColumn("models", F.lit(1000)).crossJoin(spark.range(40_000).select(F.col("id").alias("weapon"), F.lit(1).alias("target")))
    want = combat.expected(rows).agg(F.sum("expected_wounds")).first()[0]
    start = time.monotonic()
    (got,) = combat.summary(combat.simulate(rows, ["target"], "weapon", seed=5), ["target"]).collect()
    assert got["iterations"] == 5000 and abs(got["mean"] - want) < 0.001 * want and time.monotonic() - start < 60


def test_glicko_costs_rows_not_groups(spark):
    """300,000 players, some with periods in two batches; each as if rated by itself."""
    rows = spark.range(300_000).select((F.col("id") - F.col("id") % 3).alias("player"), (F.col("id") % 3).alias("period"), (F.col("id") % 4).alias("wins"), (F.col("id") % 5).alias("losses"), F.lit(None).cast("int").alias("draws"))
    rows = rows.unionByName(rows.withColumn("player", -1 - F.col("player")))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        start = time.monotonic()
        found = ratings.glicko(rows).persist()
        assert found.count() == 600_000 and time.monotonic() - start < 40
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for player in (0, 999, 150_000, -150_001):
        first, state = player if player >= 0 else -1 - player, ratings.NEW_PLAYER
        for r in found.filter(F.col("player") == player).orderBy("period").collect():
            i = first + r["period"]
            assert r["before"] == state[0]
            state = ratings.glicko_period(state, [(*ratings.UNKNOWN, s, n) for s, n in ((1.0, i % 4), (0.0, i % 5)) if n])
            assert (r["rating"], r["deviation"], r["volatility"], r["delta"]) == (*state, state[0] - r["before"])
    found.unpersist()
