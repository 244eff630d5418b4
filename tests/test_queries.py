"""Every query with SQL against DuckDB on the smallest tables, and worked examples of the rest."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridian.operators import dml, ratings, resolve
from meridian.plans import cases, catalog, combat, files, flows, registry, relational, rosters, stateful, summaries, texts  # noqa: F401  (the others fill the registry)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    cols = sorted(df.columns)
    value = lambda v: None if pd.isna(v) else round(float(v), 5) if isinstance(v, float) else v
    return sorted((tuple(value(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, oracle, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), oracle.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_elo(spark):
    games = spark.createDataFrame([("a", 1, 1, 2, 1.0), ("a", 2, 1, 2, 0.5), ("b", 1, 3, 4, 0.0)], "pool string, seq int, p1 long, p2 long, score double")
    got = {r["player"]: r["rating"] for r in ratings.elo(games).collect()}
    assert got == {1: 1215.0, 2: 1185.0, 3: 1184.0, 4: 1216.0}


def test_upsert_with_null_keys_and_insert_only_columns(spark):
    base = spark.createDataFrame([(1, "a", 1), (None, "n", 2)], "k int, name string, made int")
    new = spark.createDataFrame([(1, None, 9), (None, "m", 9), (3, "c", 9)], "k int, name string, made int")
    assert {tuple(r) for r in dml.upsert(base, new, ["k"], ("made",)).collect()} == {(1, None, 1), (None, "m", 2), (3, "c", 9)}


def test_account_takes_the_first_user(spark):
    users = spark.createDataFrame([(2, "Bo", "Al"), (1, "al", None)], "id int, username string, display string")
    names = spark.createDataFrame([(" AL ",), ("bo",), ("x",), (None,)], "name string")
    assert {r["name"]: r["user"] for r in resolve.account(names, users).collect()} == {" AL ": 1, "bo": 2, "x": None, None: None}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).filter(F.col("faction") == "").count() == 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_best_match_of_awkward_rows(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", None), (4, None, "x"), (5, "c", "x"), (6, "b", "x"), (6, "a", "x")], "id int, key string, own string")
    right = spark.createDataFrame([(9, "a", "x"), (7, "a", "z"), (8, "a", "x"), (None, "b", "x"), (3, "b", "z"), (1, None, "x")], "other int, key string, brand string")
    got = resolve.best_match(left, right, ("own", "brand"), "other")
    assert got.columns == ["id", "key", "own", "other"]
    assert {r["id"]: r["other"] for r in got.collect()} == {1: 8, 2: 7, 3: 7, 4: None, 5: None, 6: 8}


def test_best_match_costs_rows_not_pairs(spark):
    """200,000 rows of one key on both sides: 40 billion pairs."""
    rows = spark.range(200_000).withColumns({"key": F.lit("a"), "own": F.col("id") % 10})
    right = rows.select(F.col("id").alias("other"), "key", F.col("own").alias("brand"))
    assert resolve.best_match(rows, right, ("own", "brand"), "other").filter("other = own").count() == 200_000
