"""N-gram Jaccard join: rare-first prefix filtering, each surviving pair verified once.

Documents are sets of distinct word shingles. Two link when their Jaccard similarity
is at least a threshold. Documents with equal sets form a class; one of them stands
for it. Shingles are ordered by document frequency, rarest first; two linked sets
must share one of their first n - ceil(t*n) + 1 shingles (prefix filter), be of
similar size (length filter), and have enough shingles left behind the first shared
one (positional filter). Before a pair's sets travel, 16 counts per set over hash
ranges bound the overlap (suffix filter).

Frequencies are counted where shingles meet: each chunk of documents sends each
distinct shingle once to its bucket and gets a number back. Pairs are first made
with one anchor per prefix shingle, which links a group of copies with as many pairs
as documents; what links already need no further pair. Then every pair of documents
that share a prefix shingle and are in different components is verified. So a large
group is never expanded into all of its pairs, and no link between components is
lost. Such pairs are sought within classes of set sizes a factor of 100/percent wide,
as linked sets lie in the same class or in neighbours. For verification the anchors'
sets travel to the chunks of their partners.

A shingle that very many documents have in their prefix is never gathered in one task:
its rows meet a broadcast of their anchor where they are (at most HOT_KEYS such
shingles), and in the second pass its rows are dealt over salts, each with a copy of
the rows they may pair with.

Cases: null, blank and empty texts have empty sets, link with nothing and are their
own component. Fewer words than a shingle: the whole sequence is the one shingle.
Rows that share an id are one vertex, each with its own set. A null id links with
nothing and has a null component. Every input row gives one output row.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm import _text as T
from meridian.llm._graph import components
from meridian.llm._io import HOT_ROWS, chunk_of, chunked, hot_keys, looked_up, partitions, written
from meridian.llm.substring_dedup import ASK, KEEP, MAIL, _Chunk, _mail, _replied, _split, _state

SIG = 16


class _Sets(_Chunk):
    """A chunk's documents with their shingle sets."""

    def __init__(self, docs: pa.Table, width: int):
        super().__init__(docs)
        self.width = width
        self.windows = T.window_hashes(self.hashes, width)

    def _hash(self):
        self.buf = T.LOWER[self.buf]
        super()._hash()

    def of(self, d: int) -> np.ndarray:
        """The sorted distinct shingles of document d."""
        a, b = int(self.words.first[d]), int(self.words.first[d + 1])
        if b - a >= self.width:
            return np.unique(self.windows[a : b - self.width + 1])
        return T.window_hashes(self.hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _describe(docs: pa.Table, width: int) -> pa.Table:
    sets = _Sets(docs, width)
    n, h1, h2 = (np.zeros(len(sets.off) - 1, np.uint64) for _ in range(3))
    for d in range(len(n)):
        s = sets.of(d)
        n[d], h1[d], h2[d] = len(s), s.sum(), T.mix(s).sum()
    return pa.table({"id": sets.ids, "n": n.view(np.int64), "h1": h1.view(np.int64), "h2": h2.view(np.int64)})


def _ask_frequencies(chunk_no: int, docs: pa.Table, standing: pa.Table, width: int, buckets: int) -> pa.Table:
    """Each distinct shingle of the chunk's class representatives, with the number of those that have it."""
    sets = _Sets(docs, width)
    left = {(a, b, c) for a, b, c in zip(standing["id"].to_pylist(), standing["h1"].to_pylist(), standing["h2"].to_pylist(), strict=True)}
    chosen, found = [], []
    ids = sets.ids.to_pylist()
    wanted = {x[0] for x in left}
    for d, i in enumerate(ids):
        if i in wanted:
            s = sets.of(d)
            key = (i, int(s.sum().view(np.int64)), int(T.mix(s).sum().view(np.int64)))
            if key in left:
                left.discard(key)
                chosen.append(d)
                found.append(s)
    flags = np.asarray(chosen, np.int64)
    keys, count = np.unique(_df_keys(np.concatenate(found), buckets), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))
    rows = [(b, ASK, np.concatenate([(keys[i:j] & T.U64(0xFFFFFFFF)).astype(np.uint32), count[i:j].astype(np.uint32)]).tobytes()) for b, i, j in _split(keys)]
    return _mail(chunk_no, [*rows, (chunk_no % buckets, KEEP, _state(flags, len(ids)))])


def _df_keys(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> T.U64(32)) % T.U64(buckets) << T.U64(32) | h & T.U64(0xFFFFFFFF)


def _sum_frequencies(asked: list[bytes]) -> list[bytes]:
    parts = [np.frombuffer(x, np.uint32).reshape(2, -1) for x in asked]
    if not parts:
        return []
    _, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.bincount(back, np.concatenate([p[1] for p in parts]))[back].astype(np.uint32)
    return [x.tobytes() for x in np.split(total, np.cumsum([p.shape[1] for p in parts])[:-1])]


def _prefixes(docs: pa.Table, mail: pa.Table, width: int, percent: int, buckets: int) -> pa.Table:
    """The shingles of each representative's prefix that another one has too: token, id, set size, position, counts by hash range."""
    sets = _Sets(docs, width)
    kinds, bs, data = np.asarray(mail["kind"]), np.asarray(mail["bucket"]), mail["data"].to_pylist()
    n_docs = len(sets.off) - 1
    chosen = next((np.flatnonzero(np.unpackbits(np.frombuffer(d, np.uint8), count=n_docs)) for k, d in zip(kinds, data, strict=True) if k == KEEP), np.zeros(0, np.int64))
    found = [sets.of(int(d)) for d in chosen]
    out: dict[str, list] = {"token": [], "id": [], "n": [], "pos": []}
    if found:
        df = np.concatenate([np.frombuffer(data[i], np.uint32) for i in sorted(np.flatnonzero(kinds == ASK), key=lambda i: bs[i])])
        every = np.concatenate(found)
        _, back = np.unique(_df_keys(every, buckets), return_inverse=True)
        at = 0
        for d, s in zip(chosen, found, strict=True):
            n = len(s)
            own = df[back[at : at + n]]
            at += n
            order = np.argsort(own, kind="stable")[: n - (percent * n + 99) // 100 + 1]  # ties stay in the order of the hashes
            pos = np.flatnonzero(own[order] > 1)
            if len(pos):
                out["token"].append(s[order[pos]])
                out["pos"].append(pos)
                out["n"].append(np.full(len(pos), n))
                out["id"].append(np.full(len(pos), sets.rank[d]))
    cols = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
    return pa.table({"token": cols["token"].view(np.int64), "id": cols["id"], "n": cols["n"].astype(np.int32), "pos": cols["pos"].astype(np.int32)})


def _signature(s: np.ndarray) -> np.ndarray:
    return np.bincount((s >> T.U64(60)).astype(np.int64), minlength=SIG).astype(np.int32)


def _send_sets(docs: pa.Table, asked: pa.Table, width: int) -> pa.Table:
    """The sets of anchors, once for each chunk with partners."""
    sets = _Sets(docs, width)
    to: dict[int, list[int]] = {}
    for i, c in zip(asked["id"].to_pylist(), asked["to"].to_pylist(), strict=True):
        to.setdefault(i, []).append(c)
    chunk, ids, data = [], [], []
    for d, i in enumerate(sets.ids.to_pylist()):
        for c in to.get(i, ()):
            chunk.append(c)
            ids.append(i)
            data.append(sets.of(d).tobytes())
    return pa.table({"chunk": pa.array(chunk, pa.int32()), "y": pa.array(ids, pa.int64()), "x": pa.array([None] * len(ids), pa.int64()), "set": pa.array(data, pa.binary())})


def _verify(docs: pa.Table, mail: pa.Table, width: int, percent: int) -> pa.Table:
    """Links between this chunk's documents and the anchors whose sets have come. One anchor's set is open at a time."""
    sets = _Sets(docs, width)
    rows: dict[int, list[int]] = {}
    for d, i in enumerate(sets.ids.to_pylist()):
        rows.setdefault(i, []).append(d)
    ys, xs, data = mail["y"].to_pylist(), mail["x"].to_pylist(), mail["set"]
    partners: dict[int, list[int]] = {}
    for y, x in zip(ys, xs, strict=True):
        if x is not None:
            partners.setdefault(y, []).append(x)
    u, v = [], []
    cache: dict[int, np.ndarray] = {}
    for k, (y, x) in enumerate(zip(ys, xs, strict=True)):
        if x is not None:
            continue
        a = np.frombuffer(data[k].as_py(), np.uint64)
        sig = _signature(a)
        for x in partners.get(y, ()):
            for d in rows.get(x, ()):
                if d not in cache:
                    cache[d] = sets.of(d)
                b = cache[d]
                if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    continue
                need = -(-percent * (len(a) + len(b)) // (100 + percent))
                if int(np.minimum(sig, _signature(b)).sum()) < need:
                    continue
                common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
                if 100 * common >= percent * (len(a) + len(b) - common):
                    u.append(x)
                    v.append(y)
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _fits(a: str, b: str, percent: int) -> str:
    """Length and positional filter for prefix rows a and b of one token."""
    return f"""100L * least({a}.n, {b}.n) >= {percent}L * greatest({a}.n, {b}.n)
        and 1 + least({a}.n - {a}.pos, {b}.n - {b}.pos) - 1 >= ceil({percent}L * ({a}.n + {b}.n) / {100.0 + percent})"""


def similarity_links(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, links): each row's id and set (n, h1, h2); the representative of each set; verified links u-v between representatives, enough to connect what is connected."""
    spark = docs.sparkSession
    p = partitions(spark)
    n_chunks = 2 * p
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Rows without an id are nobody's partners, so any chunk will do for them.
    parts = chunked(keyed, "id", "text", [F.coalesce(F.col("id"), F.xxhash64("text"))], n_chunks)
    home = lambda c: chunk_of(n_chunks, F.col(c))

    sets = written(parts.groupBy("chunk").applyInArrow(lambda docs: _describe(docs, width), "id long, n long, h1 long, h2 long"), "sets")
    classes = written(sets.filter("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "classes")
    standing = classes.select(home("rep").alias("chunk"), F.col("rep").alias("id"), "h1", "h2")

    asked = parts.groupBy("chunk").cogroup(standing.groupBy("chunk")).applyInArrow(lambda key, docs, standing: _ask_frequencies(key[0].as_py(), docs, standing, width, p), MAIL)
    mail = asked.groupBy("bucket").applyInArrow(lambda mail: _replied(mail, _sum_frequencies), MAIL)
    index = written(parts.groupBy("chunk").cogroup(mail.groupBy("chunk")).applyInArrow(lambda key, docs, mail: _prefixes(docs, mail, width, percent, p), "token long, id long, n int, pos int"), "prefixes")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs(x, y); y's set goes to x's chunk, so y is the one with more partners."""
        pairs = written(pairs, "pairs").withColumn("to", home("x"))
        wanted = pairs.select(home("y").alias("chunk"), F.col("y").alias("id"), "to").distinct()
        sent = parts.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(lambda key, docs, asked: _send_sets(docs, asked, width), "chunk int, y long, x long, set binary")
        mail = sent.union(pairs.select(F.col("to").alias("chunk"), "y", "x", F.lit(None).cast("binary").alias("set")))
        return written(parts.groupBy("chunk").cogroup(mail.groupBy("chunk")).applyInArrow(lambda key, docs, mail: _verify(docs, mail, width, percent), "u long, v long"), "verified")

    # One anchor per shingle: as many pairs as documents, however large the group.
    anchor = written(index.groupBy("token").agg(F.min(F.struct("id", "n", "pos")).alias("a"), F.count("*").alias("rows")).filter("rows > 1").select("token", "a", "rows"), "anchors")
    total = index.count()
    stars = looked_up(index.alias("r"), anchor.select("token", "a"), "token", hot_keys(anchor, "token", total)).filter("id != a.id and " + _fits("r", "a", percent))
    links = verified(stars.select(F.col("id").alias("x"), F.col("a.id").alias("y")).distinct())

    # Every other pair that a shared prefix shingle proposes, unless it is linked already.
    labels = components(links)
    rows = index.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    mixed = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("rows")).filter("lo != hi").select("token", "rows")
    rows, mixed = written(rows, "labelled"), written(mixed, "mixed")
    rows = looked_up(rows, mixed.select("token"), "token", hot_keys(mixed, "token", total))
    # Linked sets differ by less than 1 in it; at 100 percent they have one size.
    size = F.log("n") / (log(100 / percent) * (1 + 1e-9)) if percent < 100 else F.col("n")
    rows = written(rows.withColumn("class", F.floor(size).cast("int")), "open")
    per_label = rows.groupBy("token", "label").agg(F.count("*").alias("rows"))
    main = per_label.groupBy("token").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), F.sum("rows").alias("rows"), F.max("rows").alias("most"))
    main = written(main, "main")
    facts = main.select("token", "main", F.ceil(F.col("rows") / HOT_ROWS).alias("cuts_a"), F.ceil((F.col("rows") - F.col("most")) / HOT_ROWS).alias("cuts_r"))
    rows = written(looked_up(rows, facts, "token", hot_keys(main, "token", total)), "open")
    dealt = lambda cuts: F.pmod(F.xxhash64("id"), F.col(cuts))
    each = lambda cuts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(cuts) - 1))
    left = rows.filter("label != main").withColumn("class", F.explode(F.array(*(F.col("class") + k for k in (-1, 0, 1)))))
    left = left.withColumn("salt_r", dealt("cuts_r")).withColumn("salt_a", each("cuts_a"))
    right = rows.withColumn("salt_a", dealt("cuts_a")).filter("cuts_r > 0").withColumn("salt_r", each("cuts_r"))
    pairs = (
        left.alias("r").join(right.alias("a"), ["token", "class", "salt_r", "salt_a"])
        .filter("r.label != a.label and (a.label = a.main or a.id < r.id) and " + _fits("r", "a", percent))
        .select(F.when(F.expr("a.label = a.main"), F.col("a.id")).otherwise(F.col("r.id")).alias("x"), F.when(F.expr("a.label = a.main"), F.col("r.id")).otherwise(F.col("a.id")).alias("y")).distinct()
    )
    more = verified(pairs)

    # Rows that share an id are one vertex.
    own = F.struct("n", "h1", "h2")
    known = sets.filter("n > 0 and id is not null")
    twice = known.groupBy("id").agg(F.min(own).alias("a"), F.max(own).alias("b")).filter("a != b").select("id")
    reps = known.join(twice, "id").join(classes, ["n", "h1", "h2"]).groupBy("id").agg(F.collect_set("rep").alias("reps"))
    same_id = reps.select(F.array_min("reps").alias("u"), F.explode("reps").alias("v")).filter("u != v")
    return sets, classes, links.union(more).union(same_id)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of docs."""
    sets, classes, links = similarity_links(docs, width, percent, id_col, text_col)
    found = components(links).select(F.col("id").alias("rep"), "component")
    facts = classes.join(found, "rep", "left").select(F.struct("n", "h1", "h2").alias("own"), F.coalesce("component", "rep").alias("component_id"))
    hot = hot_keys(classes.select(F.struct("n", "h1", "h2").alias("own"), "rows"), "own", sets.count())
    linked = F.col("n") > 0
    rows = sets.filter(linked & F.col("id").isNotNull()).select("id", "n", F.struct("n", "h1", "h2").alias("own"))
    alone = sets.filter(~linked | F.col("id").isNull()).select("id", "n", F.col("id").alias("component_id"))
    member = looked_up(rows, facts, "own", hot).select("id", "n", "component_id").union(alone)
    return member.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
