"""Whitening against numpy over all rows at once, exact numbers against Python's, awkward rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from meridian.llm import queries, whitening


def check(rows, got, components=32):
    """rows: (id, components). got: the result's rows."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(col) for col in zip(*x, strict=True)]
    off = np.array([[n * a - s for a, s in zip(v, sums, strict=True)] for v in x], float) / n
    cov = off.T @ off / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1], vec[:, ::-1]
    k = min(components, d)
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    w = np.zeros((n, k))
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    for i, (key, _) in enumerate(rows):
        assert sorted(by[key]) == list(range(1, k + 1))
        w[i] = [by[key][c]["whitened"] for c in range(1, k + 1)]
        assert {r["deviation"] for r in by[key].values()} == {sum((n * a - s) ** 2 for a, s in zip(x[i], sums, strict=True))}
    some = by[rows[0][0]]
    assert np.allclose([some[c]["explained"] for c in range(1, k + 1)], e[:k] / e.sum(), rtol=1e-9, atol=1e-15)
    usable = e[:k] > e[0] * 1e-12
    for c in np.flatnonzero(usable):  # the eigenvectors are those of the covariance, either sign
        want = off @ vec[:, c] / np.sqrt(e[c])
        alone = all(abs(e[c] - e[j]) > 1e-6 * e[0] for j in range(d) if j != c)
        assert not alone or np.allclose(w[:, c], want, atol=1e-6) or np.allclose(w[:, c], -want, atol=1e-6)
    error = np.abs(w.T @ w / n - np.eye(k))[np.ix_(usable, usable)].max(initial=0)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and abs(got[0]["identity_error"] - error) < 1e-9 and error < 1e-8


@pytest.mark.parametrize("parts", [1, 2, 37])
def test_whitening_by_brute_force(spark, parts):
    r = np.random.default_rng(parts)
    v = r.normal(size=(700, 40)) @ r.normal(size=(40, 40)) + 5
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    df = spark.createDataFrame(df.rdd.glom().flatMap(lambda x: x), df.schema) if parts == 2 else df
    check(rows, whitening.whitened(df, whitening.fit(df, fan_in=3), components=32).collect())


def test_merges_lose_nothing():
    r = random.Random(1)
    x = np.array([[r.randint(-90, 90) + 10**6 for _ in range(6)] for _ in range(101)], np.int64)
    cuts = [0, 1, 2, 5, 40, 41, 101]
    parts = [whitening.of_rows(x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    for order in (parts, parts[::-1], parts[3:] + parts[:3]):
        a = order[0]
        for b in order[1:]:
            a = whitening.merged(a, b)
        assert a.n == 101 and (a.sums == x.sum(0)).all() and a.factor.shape[0] <= 6
        off = x - x.mean(0)
        assert np.allclose(a.factor.T @ a.factor, off.T @ off, rtol=1e-12, atol=1e-8)


def test_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r["embedding"] and not any(math.isnan(c) for c in r["embedding"])]
    check(rows, queries.op12_embedding_whitening(spark, sf_dir).collect())


def test_awkward_rows(spark):
    rows = [(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [3.0, 2.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [5.0, 2.0])]
    df = spark.createDataFrame([(*r, 7, "c") for r in rows], "vec_id long, embedding array<double>, n long, component string")
    got = whitening.whitened(df, whitening.fit(df)).collect()
    # The second component has no variance.
    assert len(got) == 8 and {r["whitened"] for r in got if r["component"] == 2} == {0.0} and got[0]["identity_error"] < 1e-12
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted((4 * x - 640) ** 2 for x in (64, 64, 192, 320))
    same = df.filter("vec_id = 6").union(df.filter("vec_id = 6"))
    assert {(r["whitened"], r["deviation"], r["explained"], r["identity_error"]) for r in whitening.whitened(same, whitening.fit(same)).collect()} == {(0.0, 0, 0.0, 0.0)}
    empty = df.limit(0)
    assert whitening.fit(empty) is None and whitening.whitened(empty, None).count() == 0 and whitening.whitened(empty, None).columns == got[0].__fields__


def test_numbers_out_of_range_and_mixed_lengths_are_errors():
    model = whitening.Model(3, np.array([0, 3]), np.eye(2), np.ones(2), np.ones(2, bool))
    assert whitening.deviation(np.array([[10**9, 1]]), model).tolist() == [9 * 10**18]
    for x in ([[2 * 10**9, 1]], [[1 << 62, 1]]):
        with pytest.raises(OverflowError):
            whitening.deviation(np.array(x), model)
    with pytest.raises(ValueError, match="lengths"):
        whitening.matrix(pa.array([[1, 2], [3]], pa.list_(pa.int64())))
