"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Components c of a vector become whole numbers x = floor(64 c) + 1000000, so that sums are
exact. A part of the rows is held as (n, sums of x, factor): the factor, at most as many
rows as there are dimensions, is diag(s) V^T of the rows less their mean, with all of its
singular values; what two parts differ in by their means is one more row, and the stacked
factors are decomposed again. So a merge loses nothing, in any order, and no covariance of
large numbers is ever formed. Tasks fold their batches into one part, parts are merged in
groups of ``FAN_IN`` until one is left; its size depends on the dimensions alone.

From the final factor: eigenvalues s^2 / n of the covariance (divisor n), falling, and unit
eigenvectors, the same for all rows. The whitened rows are projected on them and divided
by the roots of the eigenvalues, computed from n x - S in whole numbers. A second pass
merges means and centred products of the whitened rows in the same way, for the largest
error of their covariance against the identity.

Cases: rows whose vector is null or empty, or holds null or non-finite components, are
dropped; a null id and repeated rows are rows like others; vectors of different lengths
are an error, and so are numbers whose exact results don't fit in 64 bits; components
without variance (eigenvalues within rounding of 0) are whitened to 0 and are left out of
the error; no rows give no rows. Other columns don't take part.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS, FAN_IN, ROWS = 64, 1_000_000, 32, 16, 4096
STATE = "part long, n long, sums array<bigint>, factor binary"


class Model(NamedTuple):
    n: int
    sums: np.ndarray  # of x, by dimension
    vectors: np.ndarray  # eigenvectors by row, of falling eigenvalue
    values: np.ndarray
    usable: np.ndarray  # components with variance


class Part(NamedTuple):
    n: int
    sums: np.ndarray
    factor: np.ndarray


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite: Column = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & finite).select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def matrix(col: pa.Array) -> np.ndarray:
    """The rows' whole numbers; an error if their lengths differ."""
    size = np.asarray(col.value_lengths())
    if len(size) and (size != size[0]).any():
        raise ValueError("the vectors have different lengths")
    return np.asarray(col.flatten(), np.int64).reshape(len(col), -1)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S; an error if it doesn't fit in 64 bits."""
    if len(x) and n * int(np.abs(x).max()) + int(np.abs(sums).max()) >= 1 << 63:
        raise OverflowError("n x - S is beyond 64 bits")
    return n * x - sums


def decomposed(rows: np.ndarray) -> np.ndarray:
    """diag(s) V^T of rows: all singular values, as many rows as columns at most."""
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def of_rows(x: np.ndarray) -> Part:
    sums = x.sum(0)
    return Part(len(x), sums, decomposed(deviations(x, len(x), sums) / len(x)))


def merged(a: Part, b: Part) -> Part:
    """Both parts as one; the row between their means is computed from whole numbers."""
    apart = np.array([a.n * int(t) - b.n * int(s) for s, t in zip(a.sums, b.sums, strict=True)], float) / a.n / b.n
    return Part(a.n + b.n, a.sums + b.sums, decomposed(np.vstack([a.factor, b.factor, np.sqrt(a.n * b.n / (a.n + b.n)) * apart])))


def _record(part: int, p: Part) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([p.n]), pa.array([p.sums.tolist()], pa.list_(pa.int64())), pa.array([np.ascontiguousarray(p.factor).tobytes()], pa.binary())], ["part", "n", "sums", "factor"])


def _parts(rows: pa.Table) -> list[Part]:
    out = []
    for n, sums, factor in zip(rows["n"].to_pylist(), rows["sums"].to_pylist(), rows["factor"].to_pylist(), strict=True):
        out.append(Part(n, np.array(sums, np.int64), np.frombuffer(factor).reshape(-1, len(sums))))
    if len({len(p.sums) for p in out}) > 1:
        raise ValueError("the vectors have different lengths")
    return out


def hierarchy(parts: DataFrame, merge, count: int, fan_in: int = FAN_IN) -> DataFrame:
    """parts merged in groups of fan_in by their column part (modulo count), and those again, to one."""
    count = max(1, count)
    parts = parts.withColumn("part", F.col("part") % count)
    while True:
        parts = parts.withColumn("part", (F.col("part") / fan_in).cast("long")).groupBy("part").applyInArrow(merge, parts.schema)
        count = -(-count // fan_in)
        if count == 1:
            return parts


def _merge_factors(rows: pa.Table) -> pa.Table:
    first, *others = _parts(rows)
    for p in others:
        first = merged(first, p)
    return pa.Table.from_batches([_record(rows["part"][0].as_py(), first)])


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", fan_in: int = FAN_IN) -> Model | None:
    """The eigenvectors and eigenvalues of the covariance of all usable rows; None without any."""
    rows = usable(vectors, id_col, vector_col).select("x", F.spark_partition_id().cast("long").alias("part"))

    def folded(it):
        part, number = None, 0
        for batch in it:
            for lo in range(0, batch.num_rows, ROWS):
                own = batch.slice(lo, ROWS)
                number, new = own.column(1)[0].as_py(), of_rows(matrix(own.column(0)))
                if part and len(part.sums) != len(new.sums):
                    raise ValueError("the vectors have different lengths")
                part = merged(part, new) if part else new
        if part:
            yield _record(number, part)

    parts = rows.mapInArrow(folded, STATE)
    found = hierarchy(parts, _merge_factors, rows.rdd.getNumPartitions(), fan_in).toArrow()  # one row of the dimensions' size
    if not len(found):
        return None
    (whole,) = _parts(found)
    _, s, v = np.linalg.svd(whole.factor, full_matrices=True)
    values = np.zeros(len(whole.sums))
    values[: len(s)] = s * s / whole.n
    return Model(whole.n, whole.sums, v, values, values > values[0] * len(values) * np.finfo(float).eps * 4)


def whiten(x: np.ndarray, model: Model, components: int = COMPONENTS) -> np.ndarray:
    """The first components of the whitened rows."""
    k = min(components, len(model.values))
    scale = np.where(model.usable[:k], 1 / np.sqrt(np.where(model.usable[:k], model.values[:k], 1)), 0)
    return (deviations(x, model.n, model.sums) / model.n) @ model.vectors[:k].T * scale


def deviation(x: np.ndarray, model: Model) -> np.ndarray:
    """Sums over the dimensions of (n x - S)^2; an error if they don't fit in 64 bits."""
    d = deviations(x, model.n, model.sums)
    if len(d) and int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 63:
        exact = [sum(int(v) ** 2 for v in row) for row in d]
        if max(exact) >= 1 << 63:
            raise OverflowError("the sum of (n x - S)^2 is beyond 64 bits")
        return np.array(exact, np.int64)
    return (d * d).sum(1)


def identity_error(vectors: DataFrame, model: Model, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", fan_in: int = FAN_IN) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity; of components with variance."""
    rows = usable(vectors, id_col, vector_col).select("x", F.spark_partition_id().cast("long").alias("part"))

    def both(a, b):
        n, d = a[0] + b[0], b[1] - a[1]
        return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)

    def record(part, s):
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([s[0]]), pa.array([s[1].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(s[2]).tobytes()], pa.binary())], ["part", "n", "mean", "products"])

    def folded(it):
        state, number = None, 0
        for batch in it:
            for lo in range(0, batch.num_rows, ROWS):
                own = batch.slice(lo, ROWS)
                number, w = own.column(1)[0].as_py(), whiten(matrix(own.column(0)), model, components)
                mean = w.mean(0)
                new = (len(w), mean, (w - mean).T @ (w - mean))
                state = both(state, new) if state else new
        if state:
            yield record(number, state)

    def merge(rows):
        state = None
        for n, mean, products in zip(rows["n"].to_pylist(), rows["mean"].to_pylist(), rows["products"].to_pylist(), strict=True):
            m = np.frombuffer(mean)
            new = (n, m, np.frombuffer(products).reshape(len(m), len(m)))
            state = both(state, new) if state else new
        return pa.Table.from_batches([record(rows["part"][0].as_py(), state)])

    parts = rows.mapInArrow(folded, "part long, n long, mean binary, products binary")
    found = hierarchy(parts, merge, rows.rdd.getNumPartitions(), fan_in).toArrow()
    n, products = found["n"][0].as_py(), np.frombuffer(found["products"][0].as_py())
    k = int(len(products) ** 0.5)
    on = model.usable[:k]
    off = np.abs(products.reshape(k, k) / n - np.eye(k))[np.ix_(on, on)]
    return float(off.max(initial=0.0))


def whitened(vectors: DataFrame, model: Model | None, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", error: float | None = None) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component."""
    kind = vectors.schema[id_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(vectors, id_col, vector_col)
    if model is None:
        return rows.select(F.col("id").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")))).filter("false")
    error = identity_error(vectors, model, components, id_col, vector_col) if error is None else error

    def work(it):
        total = model.values.sum()
        for batch in it:
            for lo in range(0, batch.num_rows, ROWS):
                own = batch.slice(lo, ROWS)
                x = matrix(own.column(1))
                w = whiten(x, model, components)
                m, k = w.shape
                share = model.values[:k] / total if total > 0 else np.zeros(k)
                ids = own.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                made = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, model.n), np.repeat(deviation(x, model), k), w.ravel(), np.tile(share, m), np.full(m * k, error)]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, made)], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(work, schema)
