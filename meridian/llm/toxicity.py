"""Toxic passages by maximum-scoring segments of token log-odds.

A token is a run of letters (ASCII letters, lower-cased, and all other characters beyond
ASCII). It and its beginnings of 3 to 8 characters are hashed to 2 ** ``SLOT_BITS`` slots,
whose log-odds ratios of toxic and clean training texts under Dirichlet priors are drawn
``Z`` standard deviations towards zero. A token's score is that of the longest of these
with any evidence, less a drift that makes a clean text's scan fall. In each text a linear-time scan finds
every maximal segment (Ruzzo and Tompa): those whose sum no longer or shorter segment
beats, none overlapping another.

Scores are calibrated by extreme-value theory (Karlin and Altschul). lambda solves
E[exp(lambda * s)] = 1 over clean tokens (and a prior share of all); K follows by maximum likelihood from the best
segments of the clean training texts. A segment of sum S in n tokens has the E-value
K n exp(-lambda S); it is a passage if that is at most ``ALPHA``. The best segments of a
text together have the p-value of their sum statistic; the score is the share of toxic
rows at that p-value, by a logistic curve over its negative logarithm.

Learning takes about ``fit_rows`` labelled rows of either class, by a digest of the id;
of rows alike in text and label one counts, so that copies have no weight. The labels
drawn (bounded by fit_rows) and the slots with evidence travel with the tasks; no text is
shuffled. Predicting is a map over whole texts in blocks of bounded size.

Cases: null and empty texts and such without a letter have no segment and the smallest
score; labels that are null or neither 0 nor 1 aren't learned from; a row whose label is
given twice counts once for each label; without labels of both kinds all scores are 0; one
row out for each row in; other columns pass unchanged, and added columns take the place
of existing ones with their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm import _text as T
from meridian.llm._io import dropped, written
from meridian.llm.language_id import held_out

SLOT_BITS, BEGINNINGS, BIN = 22, range(3, 9), 0.02
BLOCK = 2 << 20  # bytes in work at once
PRIOR, Z, DRIFT, ALPHA, TOGETHER, FIT_ROWS = 0.005, 2.0, 0.1, 0.01, 8, 100_000
ADDED = ("score", "n_passages", "best", "passages")
PASSAGES = "array<struct<start:bigint,length:bigint,score:double,e_value:double>>"


class Model(NamedTuple):
    slot: np.ndarray  # slots with evidence
    score: np.ndarray  # and their log-odds ratios
    drift: float
    scale: float  # lambda
    k: float
    curve: tuple[float, float]  # of the score over -log p; empty without labels of both kinds


def slots(buf: np.ndarray, cuts: np.ndarray) -> tuple[T.Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The tokens of a block, by place in it; then (tokens, their slots) for beginnings of each length, shortest first, and for whole tokens."""
    own = T.LOWER[buf[cuts[0] : cuts[-1]]]
    w = T.words_of(own, cuts - cuts[0], T.NO_LETTER)
    lead = np.r_[np.flatnonzero((own & 0xC0) != 0x80), len(own)]
    first = np.searchsorted(lead, w.start)
    size = np.searchsorted(lead, w.end) - first  # in characters
    out = []
    for k in BEGINNINGS:
        at = np.flatnonzero(size > k)
        out.append((at, (T.span_hashes(own, w.start[at], lead[first[at] + k], 1) >> T.U64(64 - SLOT_BITS)).astype(np.int64)))
    return w, [*out, (np.arange(len(w.start)), (T.span_hashes(own, w.start, w.end) >> T.U64(64 - SLOT_BITS)).astype(np.int64))]


def dense(slot: np.ndarray, score: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << SLOT_BITS, np.float32)
    out[slot] = score
    return out


def scored(levels: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray, drift: float) -> np.ndarray:
    out = np.zeros(len(levels[-1][0]))
    for at, slot in levels:
        s = table[slot]
        some = s != 0
        out[at[some]] = s[some]
    return out - drift


class Scan:
    """The maximal segments of what has been added so far."""

    def __init__(self):
        self.n, self.sum, self.found = 0, 0.0, []  # found: left sum, right sum, first byte, byte after, index of the nearest before with a smaller left sum

    def add(self, left: float, right: float, start: int, end: int) -> None:
        """A run of tokens of positive score, after which the scores so far add up to right."""
        found = self.found
        j = len(found) - 1
        while j >= 0 and found[j][0] >= left:
            j = found[j][4]
        while j >= 0 and found[j][1] < right:
            left, _, start, _, before = found[j]
            del found[j:]
            j = before
        found.append((left, right, start, end, j))

    def segments(self) -> list[tuple[int, int, float]]:
        return [(s, e, r - x) for x, r, s, e, _ in self.found]


def scan(buf: np.ndarray, off: np.ndarray, table: np.ndarray, drift: float, block: int = BLOCK, seen=None):
    """For each document: its Scan, segments by byte of the document. Yields (document, scan) when a document ends. seen: gets each document's scores, piece by piece."""
    open_doc, state = -1, Scan()
    for first, cuts in T.pieces(buf, off, block):
        w, levels = slots(buf, cuts)
        s = scored(levels, table, drift)
        total = np.r_[0.0, np.cumsum(s)]
        up = s > 0
        begin = up.copy()
        begin[1:] &= ~up[:-1]
        begin[w.first[:-1][w.first[:-1] < w.first[1:]]] |= up[w.first[:-1][w.first[:-1] < w.first[1:]]]
        last = up.copy()
        last[:-1] &= ~up[1:] | begin[1:]
        a, z = np.flatnonzero(begin), np.flatnonzero(last)
        at = np.searchsorted(a, w.first)
        for k in range(len(cuts) - 1):
            doc = first + k
            if doc != open_doc:
                open_doc, state = doc, Scan()
            lo, base = int(w.first[k]), float(total[w.first[k]])
            shift = int(cuts[0] - off[doc])
            for i in range(at[k], at[k + 1]):
                state.add(state.sum + float(total[a[i]]) - base, state.sum + float(total[z[i] + 1]) - base, int(w.start[a[i]]) + shift, int(w.end[z[i]]) + shift)
            state.n += int(w.first[k + 1]) - lo
            if seen is not None:
                seen(doc, s[lo : int(w.first[k + 1])])
            state.sum += float(total[w.first[k + 1]]) - base
            if cuts[k + 1] == off[doc + 1]:
                yield doc, state


def log_odds(toxic: np.ndarray, clean: np.ndarray, n1: float, n0: float, prior: float = PRIOR, z: float = Z) -> np.ndarray:
    """Log-odds ratios of counts out of n1 and n0 tokens, under Dirichlet priors of that share of all counts, drawn z standard deviations towards zero."""
    a, mass = prior * (toxic + clean), prior * (n1 + n0)
    delta = np.log((toxic + a) / (n1 + mass - toxic)) - np.log((clean + a) / (n0 + mass - clean))
    return np.sign(delta) * np.maximum(0, np.abs(delta) - z * np.sqrt(1 / (toxic + a) + 1 / (clean + a)))


def solve_scale(score: np.ndarray, share: np.ndarray) -> float:
    """The lambda > 0 with E[exp(lambda * score)] = 1; 0 if no score is positive or the mean isn't negative."""
    if score.max(initial=-1) <= 0 or share @ score >= 0:
        return 0.0
    lo, hi = 0.0, 1.0
    with np.errstate(over="ignore"):
        while share @ np.exp(hi * score) < 1:
            lo, hi = hi, 2 * hi
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if share @ np.exp(mid * score) < 1 else (lo, mid)
    return hi


def evidence(sums: np.ndarray, n: np.ndarray, scale: float, k: float) -> np.ndarray:
    """-log of each text's p-value: the best of the sum statistics of its 1, 2, ... largest segments (by row, falling, 0 beyond), each halved once more."""
    x = np.where(sums > 0, scale * sums - np.log(np.maximum(k * n, 1e-300))[:, None], -np.inf)
    x = np.cumsum(np.where(np.isfinite(x), x, -1e9), 1)
    out, fact = np.zeros(len(n)), 0.0
    for r in range(1, sums.shape[1] + 1):
        t = np.maximum(x[:, r - 1], 1e-9)
        if r > 1:
            fact += np.log(r) + np.log(r - 1)
        log_p = -t + (r - 1) * np.log(t) - fact if r > 1 else np.log(-np.expm1(-np.exp(-np.clip(x[:, 0], -5.0, 700.0))))
        out = np.maximum(out, np.where(x[:, r - 1] > r, -log_p - r * np.log(2), 0.0))
    return out


def logistic(e: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The curve 1 / (1 + exp(-(a + b * e))) that fits the labels best, with a little weight on a flat one."""
    x, beta = np.stack([np.ones(len(e)), e], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1e-3]), x.T @ (weight * (label - p)) - np.array([1e-6, 1e-3]) * beta)
        beta += step * min(1, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(0.0, float(beta[1]))


def posterior(e: np.ndarray, model: Model) -> np.ndarray:
    if not model.curve:
        return np.zeros(len(e))
    return 1 / (1 + np.exp(-np.clip(model.curve[0] + model.curve[1] * e, -700, 700)))


def best(state: Scan, r: int = TOGETHER) -> list[float]:
    top = sorted((x[1] - x[0] for x in state.found), reverse=True)[:r]
    return top + [0.0] * (r - len(top))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, prior: float = PRIOR, z: float = Z, drift: float = DRIFT) -> Model:
    """Learns from the rows of docs that labels names. fit_rows: rows of either class, about."""
    none = Model(np.zeros(0, np.int64), np.zeros(0, np.float32), drift, 1.0, 1.0, ())
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).distinct()
    sizes = dict(known.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return none
    share = F.when(F.col("toxic") == 1, min(1 << 30, (fit_rows << 30) // sizes[1])).otherwise(min(1 << 30, (fit_rows << 30) // sizes[0]))
    drawn = known.filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < share)  # at most about 2 * fit_rows rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    alike = texts.join(F.broadcast(drawn), "id").groupBy(F.xxhash64("text").alias("h"), F.crc32("text").alias("c"), "toxic").agg(F.min("id").alias("id")).select("id", "toxic")
    rows = texts.join(F.broadcast(alike), "id").select("toxic", "text")

    def counted(it):
        for batch in it:
            buf, off = T.string_buffers(batch.column(1))
            toxic = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            for first, cuts in T.pieces(buf, off, BLOCK):
                w, levels = slots(buf, cuts)
                doc = np.repeat(np.arange(len(cuts) - 1), np.diff(w.first))
                once = [np.unique(doc[at] << SLOT_BITS | slot) for at, slot in levels]  # each once in a document
                key, n = np.unique(np.concatenate([(x & (1 << SLOT_BITS) - 1) << 1 | toxic[first + (x >> SLOT_BITS)] for x in once]), return_counts=True)
                n1 = int(toxic[first + (once[-1] >> SLOT_BITS)].sum())
                n0 = len(once[-1]) - n1
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, key >> 1].astype(np.int32)), pa.array(np.r_[n1, np.where(key & 1, n, 0)]), pa.array(np.r_[n0, np.where(key & 1, 0, n)])], ["slot", "toxic", "clean"])

    counts = written(rows.mapInArrow(counted, "slot int, toxic long, clean long").groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-counts")
    totals = counts.filter("slot = -1").first()
    if not totals or not totals["toxic"] or not totals["clean"]:
        return none
    n1, n0 = float(totals["toxic"]), float(totals["clean"])

    def telling(it):
        for batch in it:
            s = log_odds(batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy().astype(float), n1, n0, prior, z)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.astype(np.float32))], ["slot", "score"]).filter(pa.array(s != 0))

    found = counts.filter("slot >= 0").mapInArrow(telling, "slot int, score float").toArrow()
    slot, score = found["slot"].to_numpy(), found["score"].to_numpy()

    def summed(it):
        table = dense(slot, score)
        for batch in it:
            buf, off = T.string_buffers(batch.column(1))
            m = len(off) - 1
            n, sums, bins = np.zeros(m), np.zeros((m, TOGETHER)), [{} for _ in range(m)]

            def seen(doc, s):
                for b, c in zip(*(x.tolist() for x in np.unique(np.round(s / BIN).astype(np.int64), return_counts=True)), strict=True):
                    bins[doc][b] = bins[doc].get(b, 0) + c

            for doc, state in scan(buf, off, table, drift, seen=seen):
                n[doc], sums[doc] = state.n, best(state)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(list(sums), pa.list_(pa.float64())), pa.array([list(x.items()) for x in bins], pa.map_(pa.int32(), pa.int64()))], ["toxic", "n", "sums", "bins"])

    facts = written(rows.mapInArrow(summed, "toxic int, n double, sums array<double>, bins map<int,bigint>").filter("n > 0"), "toxicity-facts")
    bins = facts.select("toxic", F.explode("bins").alias("bin", "n")).groupBy("toxic", "bin").agg(F.sum("n").alias("n")).toArrow()  # as many rows as there are bins
    weight = bins["n"].to_numpy() * (prior + (bins["toxic"].to_numpy() == 0))  # of clean tokens, under the prior
    scale = solve_scale(bins["bin"].to_numpy() * BIN, weight / max(1, weight.sum()))
    seen = facts.select("toxic", "n", "sums").toArrow()  # a few numbers for each drawn row
    dropped(counts)
    dropped(facts)
    if not scale:
        return none
    label, n = seen["toxic"].to_numpy(), seen["n"].to_numpy()
    sums = np.array(seen["sums"].to_pylist())
    own = label == 0
    k = float(own.sum() / max(1e-300, n[own] @ np.exp(-scale * sums[own, 0])))
    weight = np.where(own, max(1.0, sizes[0] / fit_rows), max(1.0, sizes[1] / fit_rows))
    return Model(slot, score, drift, scale, k, logistic(evidence(sums, n, scale, k), label, weight))


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """docs with score, n_passages, best (the largest sum of a segment) and passages (code point from 0, length in code points, sum, E-value), in order of place."""
    passed = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(*(F.col(f"`{c}`") for c in passed))
    text_at = passed.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def batches(it):
        table = dense(model.slot, model.score)
        for batch in it:
            buf, off = T.string_buffers(batch.column(text_at))
            m = len(off) - 1
            n, sums, passages = np.zeros(m), np.zeros((m, TOGETHER)), [[] for _ in range(m)]
            for doc, state in scan(buf, off, table, model.drift) if model.curve else ():
                n[doc], sums[doc] = state.n, best(state)
                for start, end, s in state.segments() if state.found else ():
                    e_value = model.k * state.n * float(np.exp(-model.scale * s))
                    if e_value <= alpha:
                        text = buf[off[doc] : off[doc + 1]]
                        head, own = (int(np.count_nonzero((x & 0xC0) != 0x80)) for x in (text[:start], text[start:end]))
                        passages[doc].append({"start": head, "length": own, "score": s, "e_value": e_value})
            score = posterior(evidence(sums, n, model.scale, model.k), model)
            made = [pa.array(score), pa.array([len(x) for x in passages], pa.int64()), pa.array(sums[:, 0]), pa.array(passages, kind)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(passed))), *made], [*passed, *ADDED])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in passed)
    return rows.mapInArrow(batches, f"{schema}score double, n_passages bigint, best double, passages {PASSAGES}")


def learned_from(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return rows.filter(~held_out(id_col))
