"""Toxic passages: segments and scores against brute force, held-out labels, awkward rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import queries, toxicity

SMALL = "/root/testdata/sf0.1"


def maximal(scores, lo=0):
    """Maximal segments by their definition: the best segment (shortest, then first), then those on either side of it."""
    top, at = 0.0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > top + 1e-9 or at and abs(s - top) <= 1e-9 and j - i < at[1] - at[0]:
                top, at = s, (i, j)
    if not at:
        return []
    i, j = at
    return maximal(scores[:i], lo) + [(lo + i, lo + j, top)] + maximal(scores[j:], lo + j)


def test_segments_by_brute_force():
    r = random.Random(4)
    for n in [*range(9), 20, 40, 40, 40, 60]:
        scores = [r.choice([-3, -2, -1, -1, 1, 2, 3]) + r.random() for _ in range(n)]
        state, total = toxicity.Scan(), 0.0
        for i, s in enumerate(scores):
            if s > 0:
                state.add(total, total + s, i, i + 1)
            total += s
        got = state.segments()
        want = maximal(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def tokens(text):
    return [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text).split(" ") if x]


@pytest.mark.parametrize("block", [16, 64, 1 << 20])
def test_tokens_scores_and_blocks(block):
    """Blocks cut long texts between tokens; the longest beginning with evidence gives a token's score."""
    texts = ["", "Toxicity TOXIC tox to 12 x", "é Éàtox-toxic " * 9, "  ", "a" * 100 + " toxic", "ßtoxicß toxics"]
    data = [x.encode() for x in texts]
    buf, off = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    evidence = {"tox": 1.0, "toxic*": 2.5, "toxi": -1.0, "éà": 9.0, "àto": 9.0}  # * marks a whole token; éà is no beginning that is counted
    table = np.zeros(1 << toxicity.SLOT_BITS, np.float32)
    for x, s in evidence.items():
        b = np.frombuffer(x.rstrip("*").encode(), np.uint8)
        h = toxicity.T.span_hashes(b, np.array([0]), np.array([len(b)]), 0 if x[-1] == "*" else 1)
        table[int(h[0]) >> 64 - toxicity.SLOT_BITS] = s

    def score(t):
        s = 0.0
        for k in toxicity.BEGINNINGS:
            s = evidence.get(t[:k], s) if len(t) > k else s
        return evidence.get(t + "*", s) - 0.25

    seen = {}
    states = dict(toxicity.scan(buf, off, table, 0.25, block, lambda doc, s: seen.setdefault(doc, []).extend(s.tolist())))
    assert sorted(states) == list(range(len(texts)))
    for i, t in enumerate(texts):
        want = [score(x) for x in tokens(t)]
        assert states[i].n == len(want) and np.allclose(seen.get(i, []), want) and states[i].sum == pytest.approx(sum(want))
        assert [x[2] for x in states[i].segments()] == pytest.approx([x[2] for x in maximal(want)])
        for start, end, _ in states[i].segments():
            assert data[i][start:end].decode()


def test_scale_and_evidence():
    score, share = np.array([-1.0, 2.0]), np.array([0.9, 0.1])
    scale = toxicity.solve_scale(score, share)
    assert share @ np.exp(scale * score) == pytest.approx(1) and toxicity.solve_scale(-score, share) == 0 == toxicity.solve_scale(np.array([-1.0]), np.array([1.0]))
    sums = np.zeros((3, 8))
    sums[1, 0], sums[2, :2] = 9.0, 9.0
    e = toxicity.evidence(sums, np.array([10.0, 10.0, 10.0]), 1.0, 0.1)
    p = 1 - math.exp(-math.exp(-9.0))  # K n is 1
    assert e[0] == 0 and e[1] == pytest.approx(-math.log(2 * p)) and e[2] == pytest.approx(18 - math.log(18) + math.log(2) - 2 * math.log(2))


def test_log_odds_need_evidence():
    got = toxicity.log_odds(np.array([1.0, 200, 0, 20]), np.array([0.0, 0, 400, 180]), 1000, 9000)
    assert got[0] == 0 and got[1] > 3 and got[2] < 0 and got[3] == pytest.approx(0, abs=0.3)


def test_held_out_labels(spark):
    out = queries.op11_toxicity(spark, SMALL)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    n = Counter((labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels)
    assert n[1, 1] > 0.85 * (n[1, 1] + n[1, 0]) and n[1, 1] > 0.85 * (n[1, 1] + n[0, 1])


def test_copies_and_held_out_rows_teach_nothing(spark):
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(2))
    rows = [(i, f"plain words number {word(i)} here and there", 0) for i in range(600)] + [(600 + i, f"you vile rotten {word(i)} beast", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    a = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    more = docs.union(spark.createDataFrame([(1000 + i, "you vile rotten aa beast", 1) for i in range(300)], docs.schema))
    b = toxicity.fit(more, more.select("doc_id", "toxic"))
    assert a.scale == b.scale and sorted(a.slot) == sorted(b.slot)
    assert toxicity.learned_from(docs).count() == sum(zlib.crc32(str(r[0]).encode()) % 4 != 2 for r in rows)
    got = {r["doc_id"]: r for r in toxicity.with_toxicity(spark.createDataFrame([(1, "Some text é, YOU VILE rotten, beast. and there"), (2, "and there"), (3, None)], "doc_id long, text string"), a).collect()}
    p = got[1]["passages"]
    assert got[1]["score"] > 0.5 > got[2]["score"] == got[3]["score"] and [(x["start"], x["length"]) for x in p] == [(13, 22)] and got[2]["passages"] == []


def test_awkward_rows(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, "x", "s"), (1, "", "x", "s"), (None, "word " * 400_000, None, "s"), (None, "a", None, None)], "doc_id long, text string, score string, slot string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.with_toxicity(docs, model)
    assert out.columns == ["doc_id", "text", "slot", "score", "n_passages", "best", "passages"] and {(r["score"], r["n_passages"]) for r in out.collect()} == {(0.0, 0)} and out.count() == 4
    assert toxicity.with_toxicity(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0
    got = queries.op11_toxicity(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and all(0 <= r["score"] <= 1 for r in got)
    toxic = spark.createDataFrame([(i, "bad worse") for i in range(50)] + [(50 + i, "good text of other words") for i in range(300)], "doc_id long, text string")
    model = toxicity.fit(toxic, toxic.select("doc_id", (F.col("doc_id") < 50).cast("int").alias("toxic")))
    assert toxicity.with_toxicity(docs, model).count() == 4
