"""Lookups, rosters and imports on small awkward rows; their queries run against SQL in test_queries."""

import random
import time
from decimal import ROUND_HALF_UP, Decimal

import pytest

from meridian.functions import text
from meridian.functions.numbers import to_fixed
from meridian.functions.white import trimmed
from meridian.operators import imports, lookups, meta, rosters
from meridian.operators.ratings import NEW_PLAYER, UNKNOWN, glicko_period
from pyspark.sql import functions as F


def test_import_update(spark):
    players = spark.createDataFrame(
        [(1, "Ann", "x", 1, 3, 1, 1), (2, "ANN", "x", 2, 0, 2, None), (3, None, "x", 3, 1, 0, 0), (4, "Bo", "y", 4, 0, 0, 0), (5, "cy", "y", 5, 2, 2, 0)],
        "seq long, player string, faction string, placement long, wins int, losses int, draws int",
    )
    state = spark.createDataFrame([("ann", 1600.0, 80.0, 0.05, 12, "p0"), ("dee", 1500.0, 90.0, 0.06, 3, "p0")], "player string, rating double, deviation double, volatility double, games long, period string")
    kept, history = imports.rated(players, state, "p1")
    after = {r["player"]: r for r in kept.collect()}
    # Both of Ann's results start from the state before the import, and the last one stays.
    want = glicko_period((1600.0, 80.0, 0.05), [(*UNKNOWN, 0.0, 2)])
    assert (after["ann"]["rating"], after["ann"]["games"], after["ann"]["period"]) == (pytest.approx(want[0]), 14, "p1")
    assert after["dee"]["rating"] == 1500.0 and after["dee"]["period"] == "p0" and "Bo" not in after
    new = glicko_period(NEW_PLAYER, [(*UNKNOWN, 1.0, 1)])
    assert after["[x@3]"]["rating"] == pytest.approx(new[0]) and after["[x@3]"]["deviation"] == pytest.approx(new[1]) and after["[x@3]"]["games"] == 1
    rows = {r["seq"]: r for r in history.collect()}
    assert set(rows) == {1, 2, 3, 5} and rows[1]["before"] == rows[2]["before"] == 1600.0 and rows[1]["delta"] > 0 > rows[2]["delta"]
    users = spark.createDataFrame([(7, "CY"), (9, "cy")], "user long, user_name string")
    assert {r["name"]: r["user"] for r in imports.new_accounts(players, state, users).collect()} == {"[x@3]": None, "Bo": None, "cy": 7}


def test_rows_without_a_parent(spark):
    rows = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 3, 12), (3, 4, None), (4, 5, 10)], "id long, seq long, parent long")
    kept, counts = imports.without_orphans(rows, ["id"], "seq", [("parent", spark.createDataFrame([(10,), (11,), (11,)], "id long"), "id")])
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 4] and tuple(counts.first()) == (5, 3, 2)
    assert tuple(imports.without_orphans(rows.limit(0), ["id"], "seq", [])[1].first()) in {(0, 0, 0), (None, None, None)}


def test_defaults_and_preferences(spark):
    df = spark.createDataFrame([(0, "", "d"), (None, None, "d"), (5, "x", "d"), (-1, "0", "d")], "n int, s string, d string")
    got = df.select(lookups.truthy(F.col("n"), F.lit(9)).alias("n"), lookups.truthy(F.col("s"), F.col("d")).alias("s")).collect()
    assert [r["n"] for r in got] == [9, 9, 5, -1] and [r["s"] for r in got][:3] == ["d", "d", "x"]
    assert lookups.preferred(df.limit(0), df).count() == 4 and lookups.preferred(df.limit(1), df).count() == 1
    assert lookups.matching(df, []).count() == 4 and lookups.visible(df.withColumn("r", F.lit("staff")), "r", " A@b ", ["a@B"]).count() == 4


def test_results_by_configuration(spark):
    asked = spark.createDataFrame([(1, None), (1, "x"), (2, None)], "unit int, mode string")
    results = lookups.cached(asked.filter("unit = 1 and mode is null"), spark.createDataFrame([], "config_hash string, result int"), ["unit", "mode"]).select("config_hash", F.lit(8).alias("result"))
    got = {(r["unit"], r["mode"]): r["result"] for r in lookups.cached(asked, results, ["unit", "mode"]).collect()}
    assert got == {(1, None): 8, (1, "x"): None, (2, None): None}


def test_errors_of_an_empty_and_of_a_bad_list(spark):
    df = spark.createDataFrame([(1, 5, "Battleline", 100, 9, True), (2, 5, None, 10, 4, None), (3, 6, "x", 10, 1, True)], "list long, unit long, role string, points long, count long, warlord boolean")
    got = {(r["list"], r["type"], r["unit"], r["value"]) for r in rosters.errors(df, 500, 3).collect()}
    assert got == {(1, "OVER_POINTS", None, 900), (2, "NO_WARLORD", None, 0), (2, "DUPLICATE_LIMIT", 5, 4)}
    assert rosters.errors(df.limit(0), 1, 1).count() == 0


def test_suggestions(spark):
    df = spark.createDataFrame([("k", 1, "D", 50, 1.0), ("k", 2, "S", 50, 2.0), ("k", 3, "A", 60, 9.0), ("k", 4, None, 60, 5.0), ("k", 5, "B", 0, 9.0), ("k", 6, "C", 40, 2.0)], "kind string, unit long, grade string, points long, contribution double")
    got = {(r["unit"], r["place"]): r["better"] for r in rosters.suggestions(df, ["kind"]).collect()}
    assert got == {(1, 1): 2, (1, 2): 6, (3, 1): 2, (4, 1): 3, (4, 2): 2, (4, 3): 6}


def test_week_and_white_space(spark):
    df = spark.createDataFrame([("2024-05-08",), ("May",), (None,), ("",)], "x string")
    assert [r["w"] for r in df.select(meta.week(F.col("x")).alias("w")).collect()] == ["2024-05-06", "May", None, ""]
    assert spark.range(1).select(trimmed(F.lit(" \t a b\xa0﻿\n")).alias("t")).first()["t"] == "a b"


def test_suggestions_over_ranges_of_a_large_group(spark):
    """A group that is cut into several ranges gives what pairs of all its units give."""
    r = random.Random(2)
    units = [(f"k{min(2, r.randrange(9))}", i, r.choice([*"SABCD", None]), r.randrange(-3, 40), r.choice([None, *map(float, range(5))])) for i in range(600)] + [("k0", 900, "S", None, 1.0), (None, 901, "S", 1, 9.0), (None, 902, "D", 5, 1.0)]
    df = spark.createDataFrame(units, "kind string, unit long, grade string, points int, contribution double")
    want = []
    for kind, unit, grade, points, _ in units:
        if points is not None:
            own = "SABCD".index(grade) if grade else 5
            found = [(-(c if c is not None else float("-inf")), u) for k, u, g, p, c in units if k == kind and u != unit and g and p is not None and 0 < p <= points and "SABCD".index(g) < own]
            want += [(unit, u, place) for place, (_, u) in enumerate(sorted(found)[:3], 1)]
    assert sorted(map(tuple, rosters.suggestions(df, ["kind"]).collect())) == sorted(want)
    assert rosters.suggestions(df.limit(0), ["kind"]).count() == 0


def test_results_alike_are_rated_once_and_all_have_a_history(spark):
    rows = spark.createDataFrame([(1, "Ann", "f", 1, 1, 0, 0), (2, "ann", "f", 1, 1, 0, 0), (3, "Bo", "f", 1, 1, 0, 0), (4, "Bo", "f", 1, 0, 2, 0), (5, "Cy", "f", 1, 0, 0, 0)], "seq long, player string, faction string, placement int, wins int, losses int, draws int")
    state = spark.createDataFrame([("Ann", 1500.0, 350.0, 0.06, 2, "p")], "player string, rating double, deviation double, volatility double, games int, period string")
    kept, history = imports.rated(rows, state, "q")
    got = {r["player"]: r for r in kept.collect()}
    assert set(got) == {"Ann", "Bo"} and got["Ann"]["games"] == 3 and got["Bo"]["games"] == 2 and got["Bo"]["rating"] < 1500 < got["Ann"]["rating"]
    assert sorted(r["seq"] for r in history.collect()) == [1, 2, 3, 4] and len({r["rating"] for r in history.collect()}) == 2


def test_markup_without_ends_takes_no_longer(spark):
    """A megabyte of opening tags: seconds, not hours; pairs within a line are as before."""
    unit = ["<b>", "<span ", "<", "<li", "<i>x", "</b>"]
    pages = spark.createDataFrame([((u * (1 << 20))[: 1 << 20],) for u in unit], "h string").repartition(4)
    began = time.time()
    assert pages.select(F.sum(F.length(text.html_to_markdown(F.col("h"))) + F.length(text.html_to_text(F.col("h"))))).first()[0] > 0
    assert time.time() - began < 60
    cases = [("<b>a</b> <b>b\n</b>c <B>d</B> <b>e", "**a** b\nc **d** e"), ('<span class="kwb">K</span><span x>y</span> <span', "**K**y <span"), ("a<br/>b<i>c</i><em>d</em>", "a\nb*c**d*")]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, h string").orderBy("i").select(text.html_to_markdown(F.col("h"))).collect()
    assert [r[0] for r in got] == [b for _, b in cases]


def test_fixed_digits_go_by_the_exact_value(spark):
    r = random.Random(1)
    values = [1.00005, 1.00015, 0.00005, 2.5, 0.03125, -1.00005, -0.03125, 0.0, 123456.78905, 1e-9] + [r.uniform(-1e6, 1e6) for _ in range(300)] + [round(r.uniform(0, 100), 5) for _ in range(300)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(to_fixed(F.col("v"))).collect()
    assert [r[0] for r in got] == [float(Decimal(v).quantize(Decimal("0.0001"), ROUND_HALF_UP)) for v in values]


def test_owned(spark):
    rows = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "id int, owner int, v string")
    asked = spark.createDataFrame([(1, 10), (1, 20), (3, 10), (None, 10)], "id int, me int")
    assert {(r["id"], r["me"], r["found"], r["v"]) for r in lookups.owned(asked, rows, {"id": "id", "me": "owner"}).collect()} == {(1, 10, True, "a"), (1, 20, False, None), (3, 10, False, None), (None, 10, False, None)}
