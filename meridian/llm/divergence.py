"""How far the sources of a language diverge from each other and from the language, by their terms.

A term is a run of ASCII letters (A-Z lower-cased) and characters beyond ASCII; a language
keeps the terms in at least ``MIN_DOCS`` of its documents. A group is a source in a
language; its smoothed share of a kept term is p = 1 + floor(1e9 (count + 1) / (N + V)),
and the divergence of p from q is floor((p - q)^2 / q). All arithmetic is in integers.

Pairs of groups are computed in tiles. Groups of a language are numbered and dealt to
blocks, the kept terms to chunks of about ``CHUNK`` terms by a hash and numbered within
them, so that a group's counts in a chunk are one packed vector of (number, p). A vector
goes to every tile of its block with another one (once for both directions); a tile reads
its vectors chunk by chunk, in order, and holds two blocks of one chunk and a submatrix of
pairs. A tile of very many chunks is split into spans, whose submatrices are added up.
What all groups of a tile lack in a chunk is added once, by its number of terms.

Counts are added up in the tasks before they are shuffled, so a source or term that is in
a third of all rows costs a row for each task. Facts of groups meet the counts by
broadcasts where a group is hot and by a join elsewhere. The best terms of a group are
found by a bounded rank in each task first.

Cases: null text, language and source count as ''; a language without kept terms has pairs
of value 0 and no terms; a group without terms has pairs; a language of one group has no
pairs; every row is a document, also with an id that others have; no documents, no rows.
Other columns don't take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm import _text as T
from meridian.llm._io import hot_keys, looked_up, partitions, written

BLOCK, CHUNK, SPAN, MIN_DOCS, TOP, SLICE = 32, 4096, 64, 3, 200, 4 << 20
GROUP = ["lang", "source"]


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))

    def counted(it):
        """Occurrences and documents by group and term of one block of texts at a time; documents of a text that goes on in the next block come with its end."""
        for batch in it:
            buf, off = T.string_buffers(batch.column(2))
            names: dict = {}
            group = np.array([names.setdefault(x, len(names)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            lang, source = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
            long: dict[bytes, None] = {}
            for first, cuts in T.pieces(buf, off, SLICE):
                own = T.LOWER[buf[cuts[0] : cuts[-1]]]
                w = T.words_of(own, cuts - cuts[0], T.NO_LETTER)
                last = first + len(cuts) - 2
                if off[first] < cuts[0] or cuts[-1] < off[last + 1]:  # a part of one text
                    one, back = T.distinct(own, w.start, w.end)
                    n, in_docs = np.bincount(back, minlength=len(one)).astype(np.int64), np.zeros(len(one), np.int64)
                    at, g = one, np.full(len(one), group[first])
                    long |= dict.fromkeys(T.cut_out(own, w.start[one], w.end[one]))
                else:
                    one, back = T.distinct(own, w.start, w.end)
                    v = max(1, len(one))
                    each, count = np.unique(np.repeat(np.arange(len(cuts) - 1), np.diff(w.first)) * v + back, return_counts=True)
                    slot, to = np.unique(group[first + each // v] * v + each % v, return_inverse=True)
                    n, in_docs = (np.bincount(to, x, len(slot)).astype(np.int64) for x in (count, None))
                    at, g = one[slot % v] if len(one) else one, slot // v
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(g)), source.take(pa.array(g)), T.spans(own, w.start[at], w.end[at]).cast(pa.string()), pa.array(n), pa.array(in_docs)], ["lang", "source", "term", "n", "docs"])
                if long and cuts[-1] == off[last + 1]:
                    g = pa.array(np.full(len(long), group[first]))
                    yield pa.RecordBatch.from_arrays([lang.take(g), source.take(g), pa.array([x.decode() for x in long], pa.string()), pa.array(np.zeros(len(long), np.int64)), pa.array(np.ones(len(long), np.int64))], ["lang", "source", "term", "n", "docs"])
                    long = {}

    return rows.mapInArrow(counted, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(1e9 (count + 1) / (total + terms)), in 64 bits for totals up to 2.9e14: 1e9 is split in two factors."""
    return F.expr(f"1 + ((({count} + 1) * 31250) div ({total} + {terms})) * 32000 + (((({count} + 1) * 31250) % ({total} + {terms})) * 32000) div ({total} + {terms})")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _dense(slots: np.ndarray, rows: list[tuple[int, np.ndarray, np.ndarray]], base: np.ndarray) -> np.ndarray:
    out = np.repeat(base[:, None], len(slots), 1)
    for g, at, p in rows:
        out[g, np.searchsorted(slots, at)] = p
    return out


class _Tile:
    """Sums over two blocks of groups: there[i, j] that of i from j, back[i, j] that of j from i."""

    def __init__(self, facts: list[tuple[int, int, int]], left: int, right: int):
        self.blocks = [sorted({(g, base) for b, g, base in facts if b == side}) for side in (left, right)]
        self.at = [{g: i for i, (g, _) in enumerate(x)} for x in self.blocks]
        self.base = [np.array([base for _, base in x], np.int64) for x in self.blocks]
        self.same, self.sides, self.seen = left == right, (left, right), 0
        shape = tuple(len(x) for x in self.blocks)
        self.there, self.back = np.zeros(shape, np.int64), np.zeros(shape, np.int64)

    def add(self, vectors: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        """The vectors (block, group, numbers, p) of one chunk."""
        slots = np.unique(np.concatenate([at for _, _, at, _ in vectors]))
        self.seen += len(slots)
        p, q = (_dense(slots, [(here[g], at, p) for b, g, at, p in vectors if b == side], base) for side, here, base in zip(self.sides, self.at, self.base, strict=True))
        for i in range(len(p)):
            d = p[i] - q
            d *= d
            self.there[i] += (d // q).sum(1)
            if not self.same:
                self.back[i] += (d // p[i]).sum(1)

    def rows(self):
        for i, (g, _) in enumerate(self.blocks[0]):
            for j, (h, _) in enumerate(self.blocks[1]):
                if g != h or not self.same:
                    yield g, h, int(self.there[i, j]), self.seen
                    if not self.same:
                        yield h, g, int(self.back[i, j]), self.seen


def tiles(vectors: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, g, h, value, seen) for all pairs of groups in each tile and span: the sums over the seen terms that some group of the tile has.

    vectors: lang, g, chunk, at (numbers of terms, rising), p. groups: lang, g, base (p of a term that g lacks), blocks, spans, all of the language.
    """
    own, n = (F.col("g") / block).cast("int"), F.col("blocks")
    facts = groups.withColumn("span", F.explode(F.sequence(F.lit(0), F.col("spans") - 1))).select("lang", "g", "blocks", "span", F.lit(-1).alias("chunk"), F.array(F.lit(0)).alias("at"), F.array("base").alias("p"))
    data = vectors.select("lang", "g", "blocks", (F.col("chunk") / SPAN).cast("int").alias("span"), "chunk", "at", "p")
    every = facts.unionByName(data).withColumns({"block": own, "other": F.explode(F.sequence(F.lit(0), n - 1))})
    rows = every.select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "span", "chunk", "block", "g", "at", "p")
    stream = rows.repartition(partitions(vectors.sparkSession), "lang", "a", "b", "span").sortWithinPartitions("lang", "a", "b", "span", "chunk")

    def out(lang: str, tile: _Tile):
        made = list(tile.rows())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(made), pa.string()), *(pa.array([x[k] for x in made], pa.int64()) for k in range(4))], ["lang", "g", "h", "value", "seen"])

    def work(it):
        key = tile = chunk = None
        facts, held = [], []
        for batch in it:
            lang, where = batch.column(0).to_pylist(), list(zip(*(batch.column(k).to_pylist() for k in range(1, 7)), strict=True))
            at, p = batch.column(7), batch.column(8)
            for i, (a, b, span, c, own, g) in enumerate(where):
                if (lang[i], a, b, span) != key:
                    if held:
                        tile.add(held)
                    if key:
                        yield out(key[0], tile or _Tile(facts, key[1], key[2]))
                    key, tile, facts, held = (lang[i], a, b, span), None, [], []
                if c < 0:
                    facts.append((own, g, p[i].values[0].as_py()))
                    continue
                if not tile:
                    tile, chunk = _Tile(facts, a, b), c
                elif c != chunk:
                    if held:
                        tile.add(held)
                    chunk, held = c, []
                held.append((own, g, np.asarray(at[i].values), np.asarray(p[i].values)))
        if held:
            tile.add(held)
        if key:
            yield out(key[0], tile or _Tile(facts, key[1], key[2]))

    return stream.mapInArrow(work, "lang string, g long, h long, value long, seen long")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, part, item, value, rank): 'pair' has all other sources of the language, 'term' the top terms that the source has more of than its language; both by falling value, then by item."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))))
    same = Window.partitionBy("lang", "term")
    counted = term_counts(docs, lang_col, source_col, text_col)
    first = (F.row_number().over(same.orderBy("source")) == 1).alias("first")
    kept = written(counted.select("lang", "source", "term", "n", F.sum("n").over(same).alias("n_lang"), F.sum("docs").over(same).alias("in_docs"), first).filter(F.col("in_docs") >= min_docs).drop("in_docs"), "terms")

    of_lang = Window.partitionBy("lang")
    sums = kept.groupBy(*GROUP).agg(F.sum("n").alias("n_group"), F.count("*").alias("rows"), F.sum(F.col("first").cast("int")).alias("firsts"))
    g = F.row_number().over(of_lang.orderBy("source")) - 1
    groups = written(
        texts.distinct().join(sums, GROUP, "left").na.fill(0, ["n_group", "rows", "firsts"])
        .select("lang", "source", "rows", "n_group", F.sum("firsts").over(of_lang).alias("terms"), F.sum("n_group").over(of_lang).alias("n_all"), g.cast("long").alias("g"), F.count("*").over(of_lang).alias("size")),
        "groups",
    )
    facts = groups.withColumns({"chunks": F.ceil(F.col("terms") / chunk).cast("int"), "blocks": F.ceil(F.col("size") / block).cast("int"), "base": F.expr("IF(terms = 0, 1L, 1 + 1000000000L div (n_group + terms))")})
    hot = hot_keys(groups, GROUP, groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    found = looked_up(kept, facts.select("lang", "source", "g", "n_group", "n_all", "terms", "chunks", "blocks"), GROUP, hot)
    shares = found.withColumns({"p": share("n", "n_group", "terms"), "q": share("n_lang", "n_all", "terms")})

    ordered = lambda: Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    over = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence("p", "q").alias("value"))
    terms = over.withColumn("rank", F.row_number().over(ordered())).filter(F.col("rank") <= top)

    placed = shares.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    number = F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term"))
    packed = placed.select("lang", "chunk", "g", "blocks", F.struct(number.alias("at"), "p").alias("x")).groupBy("lang", "chunk", "g", "blocks").agg(F.sort_array(F.collect_list("x")).alias("x"))
    vectors = packed.select("lang", "chunk", "g", "blocks", F.col("x.at").alias("at"), F.col("x.p").alias("p"))
    spans = F.greatest(F.lit(1), F.ceil(F.col("chunks") / SPAN)).cast("int")
    sums = tiles(vectors, facts.select("lang", "g", "base", "blocks", spans.alias("spans")), block).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    own, other = facts.select("lang", "g", "source", "base", "terms"), facts.select("lang", F.col("g").alias("h"), F.col("source").alias("item"), F.col("base").alias("other"))
    rest = F.expr("(terms - seen) * (((base - other) * (base - other)) div other)")
    pairs = sums.join(own, ["lang", "g"]).join(other, ["lang", "h"]).select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + rest).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(ordered())).unionByName(terms)


SQL = r"""
WITH docs AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
each AS (SELECT lang, source, k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM each GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n_lang FROM counts GROUP BY ALL HAVING sum(docs) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS n_all FROM kept GROUP BY lang),
own AS (SELECT c.* FROM counts c JOIN kept USING (lang, term)),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS n_group FROM groups LEFT JOIN own USING (lang, source) GROUP BY ALL),
shares AS (SELECT t.lang, t.source, k.term, coalesce(o.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(o.n, 0) + 1) // (t.n_group + l.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (k.n_lang + 1) // (l.n_all + l.v) AS q
  FROM totals t JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN own o USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
