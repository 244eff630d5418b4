"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed n-grams of 1 to 3 bytes (lower case; ASCII other than
letters counts as a space), weighted by 1 + log(count) and inverse document frequency
and scaled to length 1. Each language has up to ``clusters`` centroids, made by
spherical k-means; a text gets the language of the centroid with the largest cosine,
and is marked as rejected when it lies farther from that centroid than ``slack`` times
the distance within which nearly all of the centroid's own texts lie.

Document frequencies are counted over all training rows: every task adds up its own
counts of the ``DIM`` dimensions and sends one row for each. The centroids are fitted on
about ``fit_rows`` rows per language, chosen by a digest of id and text out of those that
differ in them; that bounds the fit, whatever is repeated.
The model has at most max_languages * clusters * DIM numbers and travels with the tasks.
Predicting is a map over whole texts in slices of bounded size.

Cases: null texts and texts without a letter are 'und' with score 0; so is every text
when there is nothing to learn from; ties go to the language first in order; rows with
a null language aren't learned from; one row out for each row in; other columns pass
unchanged, and added columns take the place of existing ones with their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm import _text as T

DIM = 4096
DOCS, BYTES = 256, 1 << 20  # of a slice in work
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FIT_ROWS, CLUSTERS, SLACK, MAX_LANGUAGES = 600, 4, 1.25, 1000


class Model(NamedTuple):
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # by row
    reach: np.ndarray  # distance within which a centroid's own texts lie
    idf: np.ndarray


def _slices(off: np.ndarray):
    i = 0
    while i < len(off) - 1:
        j = min(i + DOCS, max(i + 1, int(np.searchsorted(off, off[i] + BYTES, "right")) - 1))
        yield i, j
        i = j


def counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams: a row for each text. Texts are read in blocks, so that a very long one takes no more memory."""
    n = len(off) - 1
    out = np.zeros(n * DIM, np.float32)
    for lo in range(0, len(buf), BYTES):
        hi = min(len(buf), lo + BYTES)
        own = _FOLD[buf[lo : hi + 2]].astype(np.uint32)
        doc = np.searchsorted(off, np.arange(lo, min(len(buf), hi + 2)), "right") - 1 if n > 1 else np.zeros(len(own), np.int64)
        gram = np.zeros(len(own), np.uint32)
        for order in (1, 2, 3):
            gram = gram[: len(gram) - (order > 1)] if order > 1 else gram
            gram = gram << np.uint32(8) | own[order - 1 :]
            m = min(hi - lo, len(gram))
            slot = ((gram[:m] + np.uint32(order << 24)) * np.uint32(2654435761)) >> np.uint32(20)
            at = doc[:m] * DIM + slot
            if order > 1:
                at = at[doc[:m] == doc[order - 1 : order - 1 + m]]
            found = np.bincount(at - doc[0] * DIM, minlength=1)
            out[doc[0] * DIM : doc[0] * DIM + len(found)] += found
    return out.reshape(n, DIM)


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length 1; an empty text's is zero."""
    v = np.zeros_like(found)
    np.log(found, out=v, where=found > 0)
    v += found > 0
    v *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.where(norm > 0, norm, 1)[:, None]


def kmeans(v: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length 1 and the group of each row. The first seed is the row nearest to the mean, each further one the farthest from all before."""
    seeds = [int(np.argmax(v @ v.mean(0)))]
    while len(seeds) < min(k, len(v)):
        near = (v @ v[seeds].T).max(1)
        if near.min() > 1 - 1e-6:
            break
        seeds.append(int(np.argmin(near)))
    c = v[seeds].copy()
    for _ in range(rounds):
        group = np.argmax(v @ c.T, 1)
        for g in range(len(c)):
            if (group == g).any():
                m = v[group == g].mean(0)
                c[g] = m / max(float(np.linalg.norm(m)), 1e-12)
    return c, np.argmax(v @ c.T, 1)


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_rows: int = FIT_ROWS, clusters: int = CLUSTERS, max_languages: int = MAX_LANGUAGES) -> Model:
    """Learns from rows with a language. fit_rows: rows per language for the centroids, about; all rows count for the frequencies."""
    rows = rows.filter(F.col(lang_col).isNotNull() & has_letter(text_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 30)).alias("draw"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02)).orderBy("lang").limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages; the model's size would have no bound")
    empty = Model([], np.zeros((0, DIM), np.float32), np.zeros(0, np.float32), np.zeros(DIM, np.float32))
    if not sizes:
        return empty

    def frequencies(it):
        total, n = np.zeros(DIM, np.int64), 0
        for batch in it:
            buf, off = T.string_buffers(batch.column(0))
            for i, j in _slices(off):
                total += (counts(buf[off[i] : off[j]], off[i : j + 1] - off[i]) > 0).sum(0)
            n += len(off) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, np.arange(DIM)].astype(np.int32)), pa.array(np.r_[n, total])], ["dim", "n"])

    summed = rows.select("text").mapInArrow(frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM + 1, np.int64)
    for dim, n in summed:
        df[dim] = n
    idf = (np.log((1 + df[-1]) / (1 + df[:DIM])) + 1).astype(np.float32)

    share = F.lit(0)
    for lang, n in sizes:
        share = F.when(F.col("lang") == lang, min(1 << 30, (fit_rows << 30) // max(1, n))).otherwise(share)

    def vectors(it):
        for batch in it:
            buf, off = T.string_buffers(batch.column(1))
            for i, j in _slices(off):
                v = weighted(counts(buf[off[i] : off[j]], off[i : j + 1] - off[i]), idf)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([x.tobytes() for x in v], pa.binary())], ["lang", "draw", "v"])

    def cluster(rows):
        rows = rows.sort_by([("draw", "ascending"), ("v", "ascending")])
        v = np.frombuffer(b"".join(rows["v"].to_pylist()), np.float32).reshape(-1, DIM)
        c, group = kmeans(v, clusters)
        far = 1 - np.einsum("ij,ij->i", v, c[group])
        reach = [float(np.quantile(far[group == g], 0.99)) if (group == g).any() else 0.0 for g in range(len(c))]
        return pa.table({"lang": pa.array([rows["lang"][0].as_py()] * len(c), pa.string()), "n": pa.array(range(len(c)), pa.int32()), "centroid": pa.array([x.tobytes() for x in c], pa.binary()), "reach": pa.array(reach, pa.float64())})

    drawn = rows.filter(F.col("draw") < share).select("lang", "text", "draw").dropDuplicates(["lang", "draw"]).mapInArrow(vectors, "lang string, draw long, v binary")
    found = drawn.groupBy("lang").applyInArrow(cluster, "lang string, n int, centroid binary, reach double").collect()
    if not found:
        return empty
    found.sort(key=lambda r: (r["lang"], r["n"]))
    return Model([r["lang"] for r in found], np.stack([np.frombuffer(r["centroid"], np.float32) for r in found]), np.array([r["reach"] for r in found], np.float32), idf)


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


ADDED = ("lang_pred", "score", "rejected")


def predict(docs: DataFrame, model: Model, text_col: str = "text", slack: float = SLACK, reject: bool = False) -> DataFrame:
    """docs with lang_pred, score (cosine, 0 to 1) and rejected. reject: rejected texts become 'und'."""
    passed = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(*(F.col(f"`{c}`") for c in passed), has_letter(text_col).alias("__letter"))
    text_at = passed.index(text_col)

    def batches(it):
        names = sorted(set(model.langs))
        lang_of = np.array([names.index(x) for x in model.langs], np.int64)
        for batch in it:
            buf, off = T.string_buffers(batch.column(text_at))
            n = len(off) - 1
            best, score = np.full(n, -1), np.zeros(n)
            for i, j in _slices(off) if names else ():
                cos = weighted(counts(buf[off[i] : off[j]], off[i : j + 1] - off[i]), model.idf) @ model.centroids.T
                best[i:j] = np.argmax(cos, 1)
                score[i:j] = cos.max(1)
            letter = np.asarray(batch.column(len(passed)).to_numpy(zero_copy_only=False), bool) & (best >= 0)
            score = np.where(letter, np.clip(score, 0, 1), 0)
            far = letter & (1 - score > slack * model.reach[best] + 1e-6) if names else ~letter
            known = letter & ~(far & reject)
            pred = [names[lang_of[b]] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(passed))), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(far | ~letter, pa.bool_())], [*passed, *ADDED])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in passed)
    return rows.mapInArrow(batches, f"{schema}lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that aren't learned from: those whose id has a CRC-32 of 2 modulo 4. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
