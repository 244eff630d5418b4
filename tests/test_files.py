"""SQLite files, cards, Markdown, rules in text, hashes and take-backs on small awkward rows."""

import random
import sqlite3

from meridian.functions import markdown, rules
from meridian.operators import dice
from meridian.plans.files import _dealt
from meridian.sources import missions, tournaments
from meridian.sources.sqlite import Sqlite
from meridian.streaming import dice as streams
from pyspark.sql import functions as F


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", column(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_sqlite(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute('CREATE TABLE "a ""b""" (k INTEGER PRIMARY KEY, name VARCHAR(9), size DOUBLE, raw BLOB, other)')
    con.executemany('INSERT INTO "a ""b""" VALUES (?, ?, ?, ?, ?)', [(-3, "x", 1.5, b"\0\1", 7), (5, None, None, None, None), (90, "é", "2", b"", "y")])
    con.execute("CREATE TABLE none (k INT)")
    con.commit()
    con.close()
    spark.dataSource.register(Sqlite)
    read = lambda table, rows: spark.read.format("sqlite").option("table", table).option("rows", rows).load(str(tmp_path / "a.db"))
    df = read('a "b"', 10)
    assert df.dtypes == [("k", "bigint"), ("name", "string"), ("size", "double"), ("raw", "binary"), ("other", "string")]
    assert [tuple(r) for r in df.orderBy("k").collect()] == [(-3, "x", 1.5, b"\0\1", "7"), (5, None, None, None, None), (90, "é", 2.0, b"", "y")]
    assert df.rdd.getNumPartitions() == 10 and read("none", 10).count() == 0


def test_markdown(spark):
    got = one(spark, markdown.markdown_to_html, None, "", "* a\n- b\n#### c\n# ", "###  x *y*\n-z", "**b** `a<b` [t](u) & *i*")
    assert got[0] is None and got[1] == "<br/>"
    assert got[2].split("\n") == [markdown.LIST, "<li>a</li>", "<li>b</li>", "</ul>", markdown.PARAGRAPH + "#### c</p>", markdown.PARAGRAPH + "# </p>"]
    assert got[3].split("\n") == ['<h3 class="text-sm font-semibold text-slate-200 mt-3 mb-1">x <em>y</em></h3>', markdown.PARAGRAPH + "-z</p>"]
    assert "<strong" in got[4] and "a&lt;b</code>" in got[4] and '<a href="u"' in got[4] and " &amp; <em>i</em>" in got[4]


def test_pretty_json(spark):
    got = one(spark, markdown.pretty_json, None, "", "[]", '{"b": 1.0, "a": {"c": [1e2, "é"], "d": {}}}', "[NaN]", "{")
    assert got == [None, "", "[]", '{\n  "b": 1,\n  "a": {\n    "c": [\n      100,\n      "é"\n    ],\n    "d": {}\n  }\n}', "[NaN]", "{"]


def test_rules(spark):
    got = one(spark, rules.told, None, "", "Re-roll the hit rolls of 1, reroll hit roll of 1 and +1 to the wound roll; Sustained Hits 2", "-1 to hit rolls, add 1 to hit roll")
    kinds = [[(r["type"], r["value"]) for r in x] for x in got]
    assert kinds == [[], [], [("REROLL_HITS_OF_1", 0), ("REROLL_HITS", 0), ("SUSTAINED_HITS", 2), ("WOUND_MOD", 1)], [("HIT_MOD", 1), ("HIT_MOD", -1)]]


def test_hash(spark):
    def plain(text):
        h = 0x811C9DC5
        raw = text.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            x = h ^ int.from_bytes(raw[i : i + 2], "big")
            h = int(float(x - (1 << 32) if x >= 1 << 31 else x) * 16777619.0) % (1 << 32)
        return f"{h:x}"

    texts = ["", "a", '{"weapons":["Boltgun"]}', "é" * 40, "x\U0001f3b2y", "".join(chr(random.Random(1).randrange(32, 60000)) for _ in range(500))]
    assert one(spark, rules.hash32, None, *texts) == [None, *map(plain, texts)]


def test_missions(spark):
    files = [("a/primary-missions.md", "x 5 VP TAKE AND HOLD PRIMARY MISSION. 2 VP AB PRIMARY MISSION"), ("deployment-zones.md", "DAWN OF WAR INCURSION x DAWN OF WAR STRIKE FORCE HAMMER ASYMMETRIC WAR"), ("b/challenger-cards.md", "DUG IN ALL IN CHALLENGER MISSION"), ("old-twist-cards.md", "X TWIST"), ("twist-cards.md", None)]
    got = [(r["id"], r["name"], r["kind"]) for r in missions.missions(spark.createDataFrame(files, "file string, value string")).orderBy("id").collect()]
    assert got == [("mission-1", "Take And Hold", "primary"), ("mission-2", "Dawn Of War", "deployment_zone"), ("mission-3", "Hammer", "deployment_zone"), ("mission-4", "Dug In", "challenger")]
    assert missions.missions(spark.createDataFrame([], "file string, value string")).count() == 0


def test_json_unread(spark, tmp_path):
    for name, text in {"a": "[1]", "b": " {}", "c": '[{"x": 1}', "d": " "}.items():
        (tmp_path / name).write_text(text)
    assert {(r["file"][-1], r["reason"]) for r in tournaments.json_unread(spark, str(tmp_path)).collect()} == {("b", "no array"), ("c", "broken"), ("d", "no array")}


def test_take_backs(spark, tmp_path):
    rng = random.Random(3)
    actions = [(f"s{s}", i, rng.randrange(1, 7) if rng.random() < 0.55 else None) for s in range(6) for i in range(60)] + [("only", 1, None)]
    want = set()
    for s in {a[0] for a in actions}:
        table = []
        for a in (a for a in actions if a[0] == s):
            if a[2] is not None:
                table.append(a)
            elif table:
                table.pop()
        want |= set(table)
    schema = "session string, seq long, face long"
    df = spark.createDataFrame(rng.sample(actions, len(actions)), schema)
    assert {tuple(r) for r in dice.remaining(df).collect()} == want
    # Two batches of a stream, in their order.
    for n, part in enumerate((actions[:30] + actions[60:100], actions[30:60] + actions[100:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    counts = streams.drained(streams.changes(stream), "append").groupBy("session", "face").agg(F.sum("change").alias("n")).filter("n <> 0")
    plain = spark.createDataFrame(sorted(want), schema).groupBy("session", "face").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in plain.collect()}


def test_catalogues_are_dealt_over_files(spark):
    sizes = [r["count"] for r in _dealt(spark.range(50_000).coalesce(1), 5_000).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 7_500 and sum(sizes) == 50_000
    assert _dealt(spark.range(0)).count() == 0
