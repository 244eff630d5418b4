"""Sources in order, closed sessions, weeks, table changes, replays and the next round over worked examples."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridian.operators import dice, imports, lookups, quantiles, ratings, standings, swiss
from meridian.sinks import tables
from meridian.sources import ordered
from meridian.streaming import sessions, weeks
from meridian.streaming.dice import drained, in_batches


def test_ordinals_are_the_same_however_files_are_split(spark, tmp_path):
    rows = spark.range(20_000).withColumns({"part": F.col("id") % 3, "key": F.col("id") % 7, "list": F.expr("array(id, id + 1)")})
    rows.repartition("part").sortWithinPartitions("part", F.desc("id")).write.option("parquet.block.size", 8192).partitionBy("part").parquet(str(tmp_path / "t"))
    made = lambda: ordered.stamped(spark.read.parquet(str(tmp_path / "t")))
    want = sorted(range(20_000), key=lambda i: (i % 3, -i))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1g", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            number = {r["id"]: r["number"] for r in ordered.numbered(made().repartition(5, "key")).collect()}
            assert [number[i] for i in want] == list(range(1, 20_001))
            assert [r["id"] for r in ordered.first(made().repartition(4), 50).collect()] == want[:50]
            last = {r["key"]: r["id"] for r in ordered.latest(made(), "key").collect()}
            assert last == {k: [i for i in want if i % 7 == k][-1] for k in range(7)}
            item = ordered.items(made(), "list", "x").filter("id = 5").orderBy("ordinal").collect()
            assert [(r["x"], r["ordinal"]["item"]) for r in item] == [(5, 0), (6, 1)]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_part_in_many_tasks_keeps_its_order(spark, tmp_path):
    """No file holds more than about size rows, also of one part, and files of a part follow each other."""
    rows = spark.range(20_000).withColumns({"part": F.lit(0), "key": F.col("id") % 7}).repartition(6)
    got = ordered.arranged(rows, str(tmp_path / "t"), 20_000, "part", F.desc("id"), size=1000)
    sizes = [r["count"] for r in got.groupBy("ordinal.file").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 3000
    assert [r["id"] for r in got.orderBy("ordinal").collect()] == list(range(19_999, -1, -1))
    assert {r["key"]: r["id"] for r in ordered.earliest(got, "key").collect()} == {i % 7: i for i in range(19_993, 20_000)}


ACTIONS = "session string, seq long, action string, face int, batch int"


def actions(spark):
    rows = [("a", 1, "undo", None, 0), ("a", 2, "roll", 6, 0), ("b", 3, "roll", 1, 0), ("a", 4, "undo", None, 1), ("a", 5, "undo", None, 1), ("b", 6, "close", None, 1), ("b", 7, "roll", 2, 1)]
    rows += [("c", 10 + i, "roll", 6 if i % 2 else i % 6 + 1, i % 2 + 1) for i in range(60)] + [("b", 80, "roll", 2, 2), ("b", 81, "undo", None, 3), ("b", 82, "close", None, 3), ("d", 90, "close", None, 3), ("c", 91, "undo", None, 3)]
    return spark.createDataFrame(rows, ACTIONS)


def test_what_comes_after_a_close_is_refused_across_batches(spark):
    rows = actions(spark)
    verdicts, refused = sessions.outputs(in_batches(rows.drop("batch"), [F.col("seq") < 4, F.col("seq").between(4, 9), F.col("seq").between(10, 80), F.col("seq") > 80]))
    assert {tuple(r) for r in refused.collect()} == {("a", 1, sessions.NOTHING), ("a", 5, sessions.NOTHING), ("b", 7, "closed"), ("b", 80, "closed"), ("b", 81, "closed")}
    got = {r["session"]: r for r in verdicts.collect()}
    assert {s: (r["n"], r["closed"]) for s, r in got.items()} == {"a": (0, False), "b": (1, True), "c": (59, False), "d": (0, True)} and got["c"]["loaded"]
    assert spark.conf.get(sessions.STORE).endswith("HDFSBackedStateStoreProvider")


def test_verdicts_after_each_batch_are_those_of_the_rows_so_far(spark):
    rows = actions(spark).filter("session = 'c'")
    bounds = [30, 45, 69, 91]
    stream = in_batches(rows.drop("batch"), [F.col("seq").between(a + 1, b) for a, b in zip([0, *bounds], bounds, strict=False)])
    with sessions._state_store(spark):
        seen = drained(sessions.watched(stream), "update", keep_batch=True).filter("kind = 'counts'").orderBy("batch")
    for r, upto in zip(seen.collect(), bounds, strict=True):
        so_far = rows.filter(F.col("seq") <= upto).select("session", "seq", F.when(F.col("action") == "roll", F.col("face")).alias("face"))
        counts = spark.createDataFrame([("c", sum(r[f] for f in sessions.FACES), *(r[f] for f in sessions.FACES))], "session string, n long, " + ", ".join(f"{f} long" for f in sessions.FACES))
        assert dice.verdict(counts).collect() == dice.analysis(dice.remaining(so_far)).collect()


def test_weeks_are_given_once_and_late_rows_dropped(spark):
    at = lambda day, hour=0: datetime.datetime(2024, 1, day, hour)
    rows = [(1, at(1), 0), (2, at(7, 23), 0), (3, at(8, 5), 1), (4, at(7, 22), 1), (5, at(10), 1), (6, at(6), 2), (7, at(8), 2), (8, at(17), 2), (9, at(14), 3), (10, at(9), 4), (11, at(3), 4), (12, at(16), 4)]
    stream = in_batches(spark.createDataFrame(rows, "id int, ts timestamp_ntz, batch int"), [F.col("batch") == k for k in range(5)])
    got = drained(weeks.weekly(stream), "append", keep_batch=True).orderBy("week").collect()
    # 4, 6 and 9 come late but in time, 10 and 11 after their weeks were given; the third week is open.
    assert [(str(r["week"]), r["n"]) for r in got] == [("2024-01-01", 4), ("2024-01-08", 4)] and len({r["batch"] for r in got}) == 2


def test_a_change_that_fails_is_run_again(spark, tmp_path, monkeypatch):
    held = tables.Table(spark, str(tmp_path / "t"), ["k"], buckets=4).create(spark.createDataFrame([(i, "a") for i in range(20)], "k long, v string"))
    rows = lambda: {r["k"]: r["v"] for r in tables.Table(spark, str(tmp_path / "t"), ["k"], buckets=4).read().collect()}
    with pytest.raises(ValueError, match="there already"):
        held.insert("twice", spark.createDataFrame([(50, "x"), (3, "x")], "k long, v string"))
    with pytest.raises(ValueError, match="there already"):
        held.insert("twice", spark.createDataFrame([(50, "x"), (50, "y")], "k long, v string"))
    assert rows() == {i: "a" for i in range(20)}

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(tables.Table, "_mark", broken)  # before the change is prepared
    with pytest.raises(OSError, match="lost"):
        held.update("null", F.col("k") < 5, {"v": F.lit(None)})
    monkeypatch.undo()
    assert rows() == {i: "a" for i in range(20)}
    monkeypatch.setattr(tables.Table, "_replace", broken)  # after that
    with pytest.raises(OSError, match="lost"):
        held.update("null", F.col("k") < 5, {"v": F.lit(None)})
    monkeypatch.undo()
    assert held.update("null", F.col("k") < 5, {"v": F.lit(None)}) and not held.update("null", F.col("k") < 5, {"v": F.lit("other")})
    assert rows() == {i: None if i < 5 else "a" for i in range(20)}
    assert held.upsert("more", spark.createDataFrame([(3, "b"), (99, "c")], "k long, v string")) and rows()[3] == "b" and rows()[99] == "c"
    assert held.update("none", F.col("k") > 1000, {"v": F.lit("x")}) and held.delete("all", F.lit(True)) and held.delete("again", F.lit(True)) and not rows()
    assert held.insert("new", spark.createDataFrame([(1, "z")], "k long, v string")) and rows() == {1: "z"}


def test_an_update_sees_the_row_as_it_was(spark, tmp_path):
    held = tables.Table(spark, str(tmp_path / "t"), ["k"]).create(spark.createDataFrame([(1, 10, 20), (2, None, 5)], "k int, a int, b int"))
    held.update("swap", F.col("a").isNotNull() | F.lit(None).cast("boolean"), {"a": F.col("b"), "b": F.col("a")})
    assert {tuple(r) for r in held.read().collect()} == {(1, 20, 10), (2, None, 5)}


def test_manifest_counts_what_was_written(spark, tmp_path):
    rows = spark.createDataFrame([(i, None) for i in range(10)], "i int, s string").repartition(3)
    got = tables.exported({"a": rows, "b": rows.limit(0)}, str(tmp_path)).collect()
    assert sum(r["records"] for r in got) == 10 and len(got) == 3 and {r["table"] for r in got} == {"a"} and all(r["file"].endswith(".json") for r in got)
    assert spark.read.text(str(tmp_path / "a")).filter("value LIKE '%\"s\":null%'").count() == 10


def test_replayed_imports(spark):
    log = spark.createDataFrame([("x", datetime.date(2024, 2, 1), 1, "Ann", "f", 1, 3, 0, 0), ("y", datetime.date(2024, 1, 1), 2, "ANN", "f", 1, 0, 2, None), ("z", None, 3, None, "f", 4, 1, 1, 1), ("x", datetime.date(2024, 2, 1), 0, "ann", "f", 1, 0, 9, 0), ("x", datetime.date(2024, 2, 1), 9, "none", "f", 1, 0, 0, 0)], "import string, event_date date, seq long, player string, faction string, placement int, wins int, losses int, draws int")
    state = spark.createDataFrame([("Ann", 1600.0, 100.0, 0.06, 7), ("Bo", 1500.0, 350.0, 0.06, 0)], "player string, rating double, deviation double, volatility double, games int")
    changes = imports.versions(log, state)
    got = {(r["player"], r["version"]): r for r in changes.collect()}
    assert sorted(got) == [("Ann", 2), ("Ann", 3), ("[f@4]", 1)] and [got[k]["import"] for k in sorted(got)] == ["y", "x", "z"]
    lost = ratings.glicko_period((1600.0, 100.0, 0.06), [(*ratings.UNKNOWN, 0.0, 2)])
    won = ratings.glicko_period(lost, [(*ratings.UNKNOWN, 1.0, 3)])  # the last of its results in the import counts
    assert got["Ann", 3]["rating"] == pytest.approx(won[0]) and got["Ann", 3]["games"] == 12
    plain = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())
    final = imports.as_of(state, changes, 3)
    for version in range(4):
        at = imports.as_of(state, changes, version)
        assert plain(imports.as_of(at, imports.versions(log, at, after=version), 3)) == plain(final)
    assert plain(imports.as_of(state, changes, 0)) == plain(state) and len(plain(final)) == 3


def test_a_preferred_source_needs_no_job_before_the_action(spark):
    rows = spark.range(100)
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("plan", "")
    both = [lookups.preferred(rows.filter(where), rows.filter("id > 90")) for where in ("id < 3", "id < 0")]
    one = lookups.present(rows.filter("id = 50"))
    assert not tracker.getJobIdsForGroup("plan")
    assert [x.count() for x in both] == [3, 9] and one.first()["present"] and tracker.getJobIdsForGroup("plan")
    assert lookups.preferred(lookups.nothing(spark, "id long"), lookups.nothing(spark, "id long")).count() == 0 and not lookups.present(lookups.nothing(spark, "id long")).first()["present"]
    context.setLocalProperty("spark.jobGroup.id", None)


def test_a_second_source_is_not_read_where_the_first_has_rows(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    for where, scans in (("p_size < 10", 1), ("p_size < 0", 2)):
        found = lookups.preferred(part.filter(where), part.filter("p_size > 40"))
        found.collect()
        final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert final.count("FileScan") == scans


def test_next_round_without_those_who_dropped_out(spark):
    games = spark.createDataFrame([("e", 1, 1, 10, 2, 5, "P1"), ("e", 2, 3, 10, 4, 5, "P1"), ("e", 3, 5, 0, None, 0, "BYE")], "event string, game int, p1 long, vp1 long, p2 long, vp2 long, result string")
    dropped = spark.createDataFrame([("e", 1), ("e", 4)], "event string, player long")
    active = swiss.of_active(games, dropped)
    assert {(r["p1"], r["p2"], r["result"]) for r in active.collect()} == {(3, None, "P1"), (5, None, "BYE")}
    table_of = standings.standings(active, spark.createDataFrame([("e", p) for p in (2, 3, 5)], "event string, player long"))
    got = {r["player"]: (r["wins"], r["margin"], r["sos"], r["place"]) for r in table_of.collect()}
    assert got == {3: (1, 5, 0.0, 1), 5: (1, 0, 0.0, 2), 2: (0, 0, 0.0, 3)}
    rounds = spark.createDataFrame([("e", 1)], "event string, round int")
    new = {r["board"]: r for r in swiss.next_round(table_of, games.select("event", "p1", "p2"), rounds, "s").collect()}
    assert (new[1]["p1"], new[1]["p2"], new[1]["round"], new[1]["result"], new[1]["confirmed"]) == (3, 5, 2, None, False) and new[1]["mission"] in swiss.MISSIONS
    assert (new[0]["p1"], new[0]["p2"], new[0]["mission"], new[0]["vp1"], new[0]["result"], new[0]["confirmed"]) == (2, None, "BYE", 0, "BYE", True)


def test_percentiles_merge(spark):
    rows = spark.createDataFrame([("a", i % 10) for i in range(100)] + [("b", 7), ("b", None), ("c", None)], "g string, v int")
    one = quantiles.histogram(rows.filter("v < 5 or v is null"), ["g"], "v").union(quantiles.histogram(rows.filter("v >= 5"), ["g"], "v"))
    both = one.groupBy("g", "v").agg(F.sum("n").alias("n"))
    got = {r["g"]: (r["lo"], r["mid"], r["hi"]) for r in quantiles.percentiles(both, ["g"], "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).collect()}
    assert got == {"a": (0, 5, 9), "b": (7, 7, 7)}


def test_defaults_by_type(spark):
    rows = spark.createDataFrame([("0", 0, 0.0), ("", 5, float("nan")), (None, None, 2.0)], "t string, n int, d double")
    got = rows.select(lookups.truthy(F.col("t"), F.lit("x")), lookups.truthy(F.col("n"), F.lit(9)), lookups.truthy(F.col("d"), F.lit(1.5))).collect()
    assert [tuple(r) for r in got] == [("0", 9, 1.5), ("x", 5, 1.5), ("x", 9, 2.0)]


def test_a_session_costs_one_read_and_one_write_of_state():
    calls = []

    class Held:
        def __getattr__(self, name):
            return lambda *_: calls.append(name)

    processor = sessions._Session()
    processor.init(type("Handle", (), {"getValueState": lambda *_: Held()})())
    big = 2**53 + 1
    (out,) = processor.handleInputRows(("s",), iter([pd.DataFrame({"seq": [big + 1, big, 5], "action": ["undo", "close", "roll"], "face": [None, None, 3]})]), None)
    assert sorted(calls) == ["get", "update"]
    assert out[["seq", "kind", "reason", "f3"]].values.tolist() == [[big + 1, "refused", "closed", None], [None, "counts", "closed", 1]]
