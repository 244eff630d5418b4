"""Divergence of sources against brute force and SQL, awkward rows."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from meridian.llm import divergence, queries


def brute(rows, min_docs=3, top=200):
    docs = [(x or "", y or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))) for t, x, y in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= min_docs)
        count = {s: Counter(t for d in own if d[1] == s for t in d[2] if seen[t] >= min_docs) for s in {d[1] for d in own}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        for s in p:
            pairs = [(sum((p[s][t] - p[h][t]) ** 2 // p[h][t] for t in kept), h) for h in p if h != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, 10**9), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:most])]
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"block": 1, "chunk": 3}, {"block": 2, "chunk": 7, "top": 4}])
def test_audit_by_brute_force(spark, sf_dir, sizes, monkeypatch):
    if sizes:
        monkeypatch.setattr(divergence, "SPAN", 2)
        monkeypatch.setattr(divergence, "SLICE", 64)  # most texts are longer, and so come in parts
        monkeypatch.setattr("meridian.llm._io.HOT_ROWS", 2)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    assert rows_of(divergence.audit(docs, **sizes)) == brute(rows, top=sizes.get("top", 200))


def test_query_by_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({divergence.SQL})").fetchall()
    assert rows_of(queries.op13_source_divergence(spark, sf_dir)) == sorted(want)


def test_awkward_rows(spark):
    rows = [("Ab ab ÄÖ ab", "en", "a")] * 3 + [(None, "en", "b"), ("", "en", None), ("x1y2x", "en", ""), ("only once", "de", "a"), ("twice", "de", "b"), (None, None, None), ("word " * 300_000, "en", "c"), ("ab,ab", "en", "c"), ("alone here", "fr", "a"), ("alone here", "fr", "a"), ("alone here", "fr", "a")]
    docs = spark.createDataFrame([(*r, 5, "t", None) for r in rows], "text string, lang string, source string, n long, term string, chunk string")
    want = brute(rows)
    assert rows_of(divergence.audit(docs)) == want and {r[:3] for r in want} >= {("en", "b", "pair"), ("de", "a", "pair"), ("fr", "a", "term")} - {("fr", "a", "term")}
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_are_exact(spark):
    cases = [(n, t, v) for n in (0, 1, 10**9, 10**13) for t in (10**13, 123_456_789_012_345) for v in (1, 999_983)]
    got = spark.createDataFrame(cases, "n long, t long, v long").select("n", "t", "v", divergence.share("n", "t", "v").alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 1) // (r["t"] + r["v"]) for r in got)
    far = spark.range(1).select(F.lit(10**9 + 1).cast("long").alias("p"), F.lit(1).cast("long").alias("q")).select(divergence.divergence("p", "q").alias("d")).first()
    assert far["d"] == 10**18
