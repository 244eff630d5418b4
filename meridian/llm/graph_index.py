"""Approximate nearest neighbours by cosine: a robust-pruned directed graph for each shard.

Equal vectors form one node, which keeps the smallest of their ids; so copies neither
crowd a shard nor cut the graph into islands. Nodes are dealt to shards by a hash. In a
shard, nodes are inserted in rounds that double in size: a greedy search from the entry
node proposes neighbours, and pruning keeps a candidate only if no neighbour chosen
before is ``alpha`` times nearer to it than the new node is; edges back are added and
pruned the same way. Every row is indexed. A query goes through every shard by beam
search: a task holds one shard (at most about ``shard_rows`` nodes), and the queries
stream past it in batches. A shard is read by as many tasks as are needed to use all
partitions, so the index travels once where there are as many shards as partitions. Each
shard's best are measured again in double precision on the original vectors, and the
shards' results are merged.

The index is a table in the shared folder: a lost executor costs its shards again, not
the job.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no
part, neither as queries nor as candidates; vectors of other lengths than the query's
are no candidates; rows that share id and vector are one candidate, rows that share only
the id are several; ties go to the smaller id; a null id takes no part; fewer candidates
than k give fewer rows. Extra columns don't take part.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm._io import hot_keys, looked_up, partitions, written

SHARD_ROWS, MOST_K = 16384, 16
DEGREE, BEAM, ALPHA = 20, 48, 1.2
_ROUND = 512
NODES = "dim int, shard int, node int, entry boolean, vector array<double>, ids array<long>, neighbours array<int>"


class Index(NamedTuple):
    nodes: DataFrame  # dim, shard, node, entry, vector, ids (the smallest of equal vectors), neighbours
    shards: int


def _distances(x: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """1 - cosine of each row's own selection of unit vectors."""
    return 1 - np.matmul(x[at], q[:, :, None])[:, :, 0]


def beam_search(x: np.ndarray, near: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For each query the best nodes seen, their distances (ascending; unused places have node -1), and the nodes expanded on the way, step by step."""
    b, width = len(q), min(beam, len(x))
    ids, dist, done = np.full((b, width), -1), np.full((b, width), np.inf, np.float32), np.zeros((b, width), bool)
    ids[:, 0], dist[:, 0] = entry, 1 - q @ x[entry]
    seen = np.zeros((b, len(x)), bool)
    seen[:, entry] = True
    trail = []
    live = np.arange(b)
    while len(live):
        left = np.where(done[live] | (ids[live] < 0), np.inf, dist[live])
        pick = left.argmin(1)
        go = left[np.arange(len(live)), pick] < np.inf
        live, pick = live[go], pick[go]
        if not len(live):
            break
        node = ids[live, pick]
        done[live, pick] = True
        trail.append((live, node))
        nb = near[node]
        new = (nb >= 0) & ~seen[live[:, None], nb]
        seen[live[:, None], np.where(new, nb, entry)] = True
        d = _distances(x, nb, q[live]).astype(np.float32)
        d[~new] = np.inf
        every = np.concatenate([dist[live], d], 1)
        order = np.argsort(every, 1, kind="stable")[:, :width]
        dist[live] = np.take_along_axis(every, order, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(new, nb, -1)], 1), order, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros_like(new)], 1), order, 1)
    return ids, dist, trail


def prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to degree neighbours of each node from its candidates (-1: none), nearest first, each not much nearer to one chosen before."""
    order = np.argsort(cand, 1, kind="stable")
    cand = np.take_along_axis(cand, order, 1)
    bad = (cand < 0) | (cand == own[:, None])
    bad[:, 1:] |= cand[:, 1:] == cand[:, :-1]
    dist = _distances(x, cand, x[own])
    left = np.where(bad, np.inf, np.maximum(dist, 0))
    v, rows = x[cand], np.arange(len(own))
    out = np.full((len(own), degree), -1)
    for r in range(degree):
        pick = left.argmin(1)
        ok = left[rows, pick] < np.inf
        if not ok.any():
            break
        out[ok, r] = cand[rows, pick][ok]
        between = 1 - np.matmul(v, v[rows, pick][:, :, None])[:, :, 0]
        # Distances of unit vectors are squares of Euclidean ones, and so alpha counts twice.
        left[ok] = np.where(alpha * alpha * between[ok] <= left[ok], np.inf, left[ok])
        left[rows[ok], pick[ok]] = np.inf
    return out


def graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Neighbours of unit vectors (-1: none) and the entry node."""
    n, room = len(x), degree + degree // 2
    near = np.full((n, room), -1)
    entry = int(np.argmax(x @ x.mean(0)))
    turn = np.random.default_rng(n).permutation(n)
    turn = turn[turn != entry]
    i, size = 0, 1
    while i < len(turn):
        own = turn[i : i + size]
        ids, _, trail = beam_search(x, near, entry, x[own], beam)
        walked = np.full((len(own), len(trail)), -1)
        for step, (live, node) in enumerate(trail):
            walked[live, step] = node
        near[own, :degree] = prune(x, own, np.concatenate([ids, walked], 1), degree, alpha)
        _link_back(x, near, own, degree, alpha)
        i, size = i + size, min(2 * size, _ROUND)
    over = np.flatnonzero((near[:, degree:] >= 0).any(1))
    for k in range(0, len(over), _ROUND):
        part = over[k : k + _ROUND]
        near[part, :degree] = prune(x, part, near[part], degree, alpha)
    return near[:, :degree], entry


def _link_back(x: np.ndarray, near: np.ndarray, own: np.ndarray, degree: int, alpha: float) -> None:
    """Edges back to the new nodes; a list without room is pruned."""
    to = near[own, :degree].ravel()
    source = np.repeat(own, degree)[to >= 0]
    to = to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, int)
    size = np.diff(np.r_[heads, len(to)])
    target = to[heads]
    held = (near[target] >= 0).sum(1)
    fits = held + size <= near.shape[1]
    place = np.arange(len(to)) - np.repeat(heads, size)
    put = np.repeat(fits, size)
    near[to[put], (np.repeat(held, size) + place)[put]] = source[put]
    full = np.flatnonzero(~fits)
    full = full[np.argsort(size[full])]  # lists of like lengths together
    at = 0
    while at < len(full):
        step = max(1, min(_ROUND, (_ROUND * 64) // int(near.shape[1] + size[full[min(len(full), at + _ROUND) - 1]])))
        part = full[at : at + step]
        wide = np.full((len(part), int(size[part].max())), -1)
        for row, g in enumerate(part):
            wide[row, : size[g]] = source[heads[g] : heads[g] + size[g]]
        kept = prune(x, target[part], np.concatenate([near[target[part]], wide], 1), degree, alpha)
        near[target[part]] = -1
        near[target[part], :degree] = kept
        at += step


def _matrix(col, dim: int) -> np.ndarray:
    return np.asarray(col.combine_chunks().flatten(), np.float64).reshape(-1, dim) if len(col) else np.zeros((0, dim))


def _unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(1, keepdims=True)
    v = v / big
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, dim) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite: Column = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), v.alias("vector"), F.size(v).alias("dim"))


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> Index:
    """Indexes every usable row."""
    p = partitions(vectors.sparkSession)
    rows = _usable(vectors, id_col, vector_col)
    # Of a vector that is everywhere each task passes on the smallest ids that results can use.
    place = F.row_number().over(Window.partitionBy("dim", "vector").orderBy("id"))
    few = rows.distinct().withColumn("place", place).filter(F.col("place") <= MOST_K + 1)
    classes = written(few.groupBy("dim", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors")
    n = classes.count()
    shards = max(1, -(-n // shard_rows), min(p, n // 1024))

    def shard(key, rows):
        dim = key[0].as_py()
        rows = rows.take(pa.array(np.argsort([x[0] for x in rows["ids"].to_pylist()], kind="stable")))
        near, entry = graph(_unit(_matrix(rows["vector"], dim)), degree, beam, alpha)
        size = (near >= 0).sum(1)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(near[near >= 0].astype(np.int32)))
        node = np.arange(len(rows), dtype=np.int32)
        same = lambda i: pa.array(np.full(len(rows), key[i].as_py(), np.int32))
        return pa.Table.from_arrays([same(0), same(1), pa.array(node), pa.array(node == entry), rows["vector"], rows["ids"], lists], ["dim", "shard", "node", "entry", "vector", "ids", "neighbours"])

    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    return Index(written(dealt.groupBy("dim", "shard").applyInArrow(shard, NODES), "graph"), shards)


class _Shard:
    """A shard's graph in memory."""

    def __init__(self, nodes: pa.Table, dim: int):
        self.dim, self.own = dim, _matrix(nodes["vector"], dim)
        lists = nodes["neighbours"].combine_chunks()
        size = np.asarray(lists.value_lengths())
        self.near = np.full((len(self.own), max(1, int(size.max(initial=0)))), -1)
        self.near[np.arange(self.near.shape[1]) < size[:, None]] = np.asarray(lists.flatten())
        self.entry = int(np.flatnonzero(nodes["entry"].combine_chunks().to_numpy(zero_copy_only=False))[0])
        self.ids = nodes["ids"].to_pylist()
        self.length = np.sqrt((self.own * self.own).sum(1))
        self.x = _unit(self.own)

    def nearest(self, q: pa.Table, k: int, beam: int) -> pa.RecordBatch:
        """Key, score and ids of the k + 1 best nodes of each query, measured in double precision."""
        asked, keys = _matrix(q["vector"], self.dim), q["key"].to_pylist()
        out = {"key": [], "score": [], "ids": []}
        found, _, _ = beam_search(self.x, self.near, self.entry, _unit(asked), beam)
        for a, key, nodes in zip(asked, keys, found, strict=True):
            at = nodes[nodes >= 0]
            score = self.own[at] @ a / (self.length[at] * np.sqrt(a @ a))
            best = sorted(zip((-score).tolist(), [self.ids[i][0] for i in at], at.tolist(), strict=True))[: k + 1]
            out["key"] += [key] * len(best)
            out["score"] += [-s for s, _, _ in best]
            out["ids"] += [self.ids[i] for _, _, i in best]
        return pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), pa.array(out["score"], pa.float64()), pa.array(out["ids"], pa.list_(pa.int64()))], ["key", "score", "ids"])


def search(index: Index, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = 2 * BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows other than its own, as far as the graphs find them."""
    if k > MOST_K:
        raise ValueError(f"k is at most {MOST_K}")
    asked = _usable(queries, id_col, vector_col)
    # Equal queries are searched once, under the smallest id. Two hashes stand for the vector where results go back.
    mark = F.struct(F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector"), "dim").alias("mark")
    firsts = written(asked.groupBy("vector", "dim").agg(F.min("id").alias("key"), F.count("*").alias("rows")), "queries")
    blocks = max(1, partitions(queries.sparkSession) // index.shards)
    nothing = lambda t: F.lit(None).cast(t)
    nodes = index.nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("dim", "shard", "block", F.lit(0).alias("kind"), F.col("node").cast("long").alias("key"), "entry", "vector", "ids", "neighbours")
    to_shards = firsts.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(index.shards - 1))))
    asking = to_shards.select("dim", "shard", "block", F.lit(1).alias("kind"), "key", nothing("boolean").alias("entry"), "vector", nothing("array<long>").alias("ids"), nothing("array<int>").alias("neighbours"))
    group = ["dim", "shard", "block"]
    stream = nodes.union(asking).repartition(max(partitions(queries.sparkSession), index.shards), *group).sortWithinPartitions(*group, "kind", "key")
    width = max(beam, 2 * k)

    def look(it):
        """Rows come by shard, its nodes before the queries to it."""
        open_, held, shard = None, [], None
        for batch in it:
            if not batch.num_rows:
                continue
            every = pa.Table.from_batches([batch])
            marks = np.stack([np.asarray(batch.column(c)) for c in range(4)], 1)
            ends = [*(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                part, own = every.slice(lo, hi - lo), tuple(marks[lo, :3].tolist())
                if own != open_:
                    open_, held, shard = own, [], None
                if marks[lo, 3] == 0:
                    held.append(part)
                elif held or shard:
                    if held:
                        shard, held = _Shard(pa.concat_tables(held), own[0]), []
                    for at in range(0, len(part), _ROUND):
                        yield shard.nearest(part.slice(at, _ROUND), k, width)

    found = stream.mapInArrow(look, "key long, score double, ids array<long>")
    # Each task passes on no more than a query's k + 1 best, so that no row grows with the shards.
    hits = found.select("key", (-F.col("score")).alias("far"), F.explode("ids").alias("id"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("far", "id"))
    best = hits.withColumn("place", place).filter(F.col("place") <= k + 1)
    best = written(best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("far", "id"))).alias("hits")), "nearest")
    facts = firsts.select("key", mark, "rows").join(best, "key")
    hot = hot_keys(facts, "mark", firsts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    each = looked_up(asked.select("id", mark).distinct(), facts.select("mark", "hits"), "mark", hot)
    rows = each.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("hits", lambda h: h.id != F.col("id")), 1, k)))
    return rows.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("vec_id"), (-F.col("col.far")).alias("score"))
