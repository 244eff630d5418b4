"""Byte-level BPE encoding and decoding by published merge ranks.

Texts are cut into pre-tokens without a regex (``_pretoken``). The distinct
pre-tokens of a batch are merged all at once: in each round every unfinished
pre-token merges its lowest-ranked pair, leftmost first; one of more than LONG bytes is
merged by a heap of its pairs in the same order, so that time hardly grows faster than
length. Results are cached by their bytes in each Python worker, up to a bound. Every document is decoded again from its
ids by the offsets of the vocabulary's bytes; one that does not come back is an error.

A map-only job: no shuffle, memory bounded by a batch of texts, a slice of the table
lost with an executor is simply encoded again.

Cases: null texts count as empty and have no ids; blank texts have ids of white space;
one row out for each row in, repeated rows and null ids too; other columns pass unchanged,
and added columns take the place of existing ones with their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meridian.llm import _text as T
from meridian.llm._cache import IdCache, Lookup
from meridian.llm._pretoken import pretokens

NONE = np.uint32(0xFFFFFFFF)
SLICE = 1 << 20  # bytes of text in work at a time
CACHED = 1 << 17  # pre-tokens kept per worker
LONG = 512  # bytes of a pre-token that is merged by itself


class Ranks:
    """Merge ranks as arrays: pairs of ids to the id of their union, and ids to bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte = np.array([rank[bytes([i])] for i in range(256)], np.uint32)
        top = max(rank.values()) + 1
        pairs = {}
        for token, r in rank.items():
            for k in range(1, len(token)):
                if (a := rank.get(token[:k])) is not None and (b := rank.get(token[k:])) is not None:
                    pairs[a << 32 | b] = r
        self.pairs = Lookup(np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.uint32, len(pairs)), NONE)
        tokens: list[bytes] = [b""] * top
        for token, r in rank.items():
            tokens[r] = token
        self.length = np.array([len(x) for x in tokens], np.int64)
        self.at = np.r_[0, np.cumsum(self.length)]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.known: dict[int, int] = {}
        self.cache = IdCache(CACHED, np.uint16 if top <= 1 << 16 else np.uint32)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id of each pair's union; NONE where the pair doesn't merge."""
        return self.pairs.get(a.astype(np.uint64) << T.U64(32) | b.astype(np.uint64))

    def merge(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given slices of bytes: flat ids, and the number for each slice."""
        alone = np.flatnonzero(end - start > LONG)
        if not len(alone):
            return self._together(buf, start, end)
        few = np.flatnonzero(end - start <= LONG)
        ids, n = self._together(buf, start[few], end[few])
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(start)
        for i, x in zip(few, np.split(ids, np.cumsum(n)[:-1]), strict=False):
            found[i] = x
        for i in alone:
            found[i] = self._by_heap(buf[start[i] : end[i]])
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def _by_heap(self, buf: np.ndarray) -> np.ndarray:
        """Ids of one slice."""
        if not self.known:
            used = np.flatnonzero(self.pairs.values != NONE)
            self.known = dict(zip(self.pairs.slots[used].tolist(), self.pairs.values[used].tolist(), strict=True))
        known, n = self.known, len(buf)
        first = self.byte[buf]
        ids, behind, before = first.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.merged(first[:-1], first[1:])
        at = np.flatnonzero(rank != NONE)
        heap = list(zip(rank[at].tolist(), at.tolist(), strict=True))
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = behind[i]
            if ids[i] < 0 or j >= n or known.get(ids[i] << 32 | ids[j]) != r:
                continue  # merged or changed since
            ids[i], ids[j] = r, -1
            k, h = behind[j], before[i]
            behind[i] = k
            if k < n:
                before[k] = i
                if (x := known.get(r << 32 | ids[k])) is not None:
                    heappush(heap, (x, i))
            if h >= 0 and (x := known.get(ids[h] << 32 | r)) is not None:
                heappush(heap, (x, h))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def _together(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of slices that are merged all at once."""
        n = end - start
        own = np.repeat(np.arange(len(n)), n)
        ids = self.byte[buf[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)]]
        done_ids, done_own = [], []
        left = self.merged(ids[:-1], ids[1:]) if len(ids) else np.zeros(0, np.uint32)
        left = np.r_[left, NONE][: len(ids)]
        left[:-1][own[:-1] != own[1:]] = NONE
        while len(ids):
            head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            size = np.diff(np.r_[head, len(ids)])
            low = np.minimum.reduceat(left, head)
            at_rest = np.repeat(low == NONE, size)
            if at_rest.any():
                done_ids.append(ids[at_rest])
                done_own.append(own[at_rest])
                ids, own, left = ids[~at_rest], own[~at_rest], left[~at_rest]
                size, low = size[low != NONE], low[low != NONE]
                if not len(ids):
                    break
                head = np.cumsum(size) - size
            hit = np.flatnonzero(left == np.repeat(low, size))
            p = hit[np.r_[True, own[hit[1:]] != own[hit[:-1]]]]  # the leftmost of each slice
            ids[p] = left[p]
            keep = np.ones(len(ids), bool)
            keep[p + 1] = False
            ids, own, left = ids[keep], own[keep], left[keep]
            p -= np.arange(len(p))
            for q in (p, p[p > 0] - 1):  # only the pairs beside a merge are new
                r = q[q + 1 < len(ids)]
                left[q[q + 1 >= len(ids)]] = NONE
                left[r] = np.where(own[r] == own[r + 1], self.merged(ids[r], ids[r + 1]), NONE)
        if not done_ids:
            return np.zeros(0, np.uint32), np.zeros(len(n), np.int64)
        ids, own = np.concatenate(done_ids), np.concatenate(done_own)
        order = np.argsort(own, kind="stable")
        return ids[order], np.bincount(own, minlength=len(n))

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents in buf, one after another, and the offsets of each."""
        start, end, first = pretokens(buf, off)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        one, back = T.distinct(buf, start, end)
        slot = self.cache.slots(T.cut_out(buf, start[one], end[one]), lambda new: self.merge(buf, start[one[new]], end[one[new]]))
        ids, to = self.cache.join(slot[back])
        return ids.astype(np.uint32), to[first]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and each document's offsets among them."""
        n = self.length[ids]
        to = np.r_[0, np.cumsum(n)]
        return self.bytes[np.arange(to[-1]) + np.repeat(self.at[ids] - to[:-1], n)], to[off]

    def round_trip(self, buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each document its ids and its bytes decoded from them."""
        ids, to = self.encode(buf, off)
        back, at = self.decode(ids, to)
        if not np.array_equal(back, buf):
            raise ValueError("a text does not come back from its ids")
        for d in range(len(off) - 1):
            yield ids[to[d] : to[d + 1]], back[at[d] : at[d + 1]]


_loaded: dict[str, Ranks] = {}


def ranks(path: str) -> Ranks:
    """The ranks of a file, once in each worker."""
    if path not in _loaded:
        _loaded[path] = Ranks(path)
    return _loaded[path]


def slices(off: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of documents with about so many bytes."""
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 added, and, as asked, ids (array<int>) and decoded (string).

    path: a file of ranks that every executor has. The ids' digest is over
    little-endian unsigned 32-bit integers.
    """
    cols = {c: f"`{c}`" for c in docs.columns}
    extra = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    def batches(it):
        for batch in it:
            made = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            ids, back = [], []
            table = ranks(path)
            buf, off = T.string_buffers(batch.column(text_at))
            for i, j in slices(off):
                for own, text in table.round_trip(buf[off[i] : off[j]], off[i : j + 1] - off[i]):
                    made["n_tokens"].append(len(own))
                    made["ids_sha256"].append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    made["decoded_sha256"].append(hashlib.sha256(text.tobytes()).hexdigest())
                    if keep_ids:
                        ids.append(own.astype(np.int32))
                    if keep_text:
                        back.append(text.tobytes().decode())
            arrays = [batch.column(k) for k in passed] + [pa.array(made["n_tokens"], pa.int64()), pa.array(made["ids_sha256"], pa.string()), pa.array(made["decoded_sha256"], pa.string())]
            names = [batch.schema.names[k] for k in passed] + list(made)
            if keep_ids:
                at = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))))
                names.append("ids")
            if keep_text:
                arrays.append(pa.array(back, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(arrays, names)

    text_at = docs.columns.index(text_col)
    added = ("n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else []), *(["decoded"] if keep_text else []))
    kept = [c for c in docs.columns if c not in added and (keep_text or c != text_col)]
    passed = [docs.columns.index(c) for c in kept]
    schema = ", ".join(f"{cols[c]} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(batches, f"{schema}, {extra}" if kept else extra)
