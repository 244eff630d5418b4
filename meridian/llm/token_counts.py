"""Token counts under a unigram model, by dynamic programming over a trie.

The model has the pieces of a published vocabulary of ranks; a piece's cost is the
negative logarithm of a Zipf probability, 1 / (rank + 2) over the sum of all. A
pre-token's segmentation is the cheapest one, with the fewest pieces among equals.
Costs are whole numbers (ten-thousandths), so that sums are exact.

The distinct pre-tokens of a slice of texts that the worker hasn't counted yet are
sorted, which lays out their trie: a node is a prefix, and its forward cost is computed
once, from those of its ancestors, for all pre-tokens that share it. The first DEEP
levels are walked level by level, all nodes of a level together. Pre-tokens that go
deeper are few, and their trie is walked branch by branch: the costs along the branch
before stay as far as the next one shares it. The count at a pre-token's last node is
stored under its bytes, up to a bound.

A map-only job; texts are read in slices, so memory doesn't grow with the table.

Cases: null and empty texts have no tokens; blank texts have pre-tokens of white space;
one row out for each row in; other columns pass unchanged, and added columns take the
place of existing ones with their names.
"""

from __future__ import annotations

import base64
from itertools import repeat
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meridian.llm import _text as T
from meridian.llm._cache import Lookup
from meridian.llm._pretoken import pretokens
from meridian.llm.byte_bpe import slices

DEEP = 64
CACHED, CACHED_BYTES = 1 << 18, 1 << 25  # pre-tokens kept per worker, and their bytes
UNIT = 10_000  # parts of a cost's unit
_COUNT = 24  # low bits of a sum that hold the number of pieces
_DEEP_COUNT = 48  # the same below the first levels
_FAR = np.int64(1) << np.int64(61)


class Unigram:
    """Costs of pieces by the hash of their bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pieces = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        total = np.log(sum(1 / (r + 2) for r in sorted(pieces.values())))
        self.cost = {piece: (int(round(UNIT * (np.log(r + 2) + total))) << _COUNT) + 1 for piece, r in pieces.items()}
        ordered = sorted(pieces)
        buf = np.frombuffer(b"".join(ordered), np.uint8)
        end = np.cumsum([len(x) for x in ordered])
        start = np.r_[0, end[:-1]]
        self.table = Lookup(T.span_hashes(buf, start, end), np.array([self.cost[x] for x in ordered], np.int64), _FAR)
        self.lengths = sorted({len(x) for x in ordered})
        self.known: dict[bytes, int] = {}
        self.held = 0

    def _branches(self, words: list[bytes]) -> list[int]:
        """Counts of sorted distinct words by the path to each one's leaf. Sums of many pieces go beyond 64 bits, so these are Python's whole numbers."""
        out, best, last = [], [0], np.zeros(0, np.uint8)
        for word in words:
            buf = np.frombuffer(word, np.uint8)
            n, m = len(buf), min(len(buf), len(last))
            differ = np.flatnonzero(buf[:m] != last[:m])
            shared = int(differ[0]) if len(differ) else m
            ends, costs, sizes = [], [], []
            for k in self.lengths:
                end = np.arange(max(k, shared + 1), n + 1)
                w = self.table.get(T.span_hashes(buf, end - k, end))
                hit = np.flatnonzero(w < _FAR)
                ends.append(end[hit])
                costs.append(w[hit])
                sizes.append(np.full(len(hit), k))
            every = np.concatenate(ends)
            order = np.argsort(every, kind="stable")
            costs = np.concatenate(costs)[order] >> _COUNT
            best[shared + 1 :] = [inf] * (n - shared)
            for e, k, w in zip(every[order].tolist(), np.concatenate(sizes)[order].tolist(), costs.tolist(), strict=True):
                best[e] = min(best[e], best[e - k] + (w << _DEEP_COUNT) + 1)
            out.append(best[n] & ((1 << _DEEP_COUNT) - 1))
            last = buf
        return out

    def measure(self, words: list[bytes]) -> np.ndarray:
        """The number of pieces of each of the given distinct pre-tokens."""
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        size = np.array([len(words[i]) for i in order], np.int64)
        out = np.zeros(len(words), np.int64)
        for at, count in ((order[size <= DEEP], self._trie), (order[size > DEEP], self._branches)):
            if len(at):
                out[at] = count([words[i] for i in at])
        return out

    def _trie(self, words: list[bytes]) -> np.ndarray:
        """Counts of sorted distinct words. Equal prefixes stand together, so a level's nodes are runs of words."""
        size = np.array([len(x) for x in words], np.int64)
        at = np.cumsum(size) - size
        buf = np.frombuffer(b"".join(words), np.uint8)
        before = np.r_[0, size[:-1]]
        new = np.zeros(len(words), bool)
        new[:1] = True
        cost, node = [np.zeros(1, np.int64)], [np.zeros(len(words), np.int32)]
        out = np.zeros(len(words), np.int64)
        for depth in range(1, int(size.max(initial=0)) + 1):
            here = np.flatnonzero(size >= depth)
            inside = before[here] >= depth
            new[here[~inside]] = True
            pair = here[inside]
            new[pair] |= buf[at[pair] + depth - 1] != buf[at[pair - 1] + depth - 1]
            first = here[new[here]]
            own = np.full(len(words), -1, np.int32)
            own[here] = np.cumsum(new[here]) - 1
            best = np.full(len(first), _FAR)
            end = at[first] + depth
            for k in self.lengths:
                if k > depth:
                    break
                w = self.table.get(T.span_hashes(buf, end - k, end))
                np.minimum(best, cost[depth - k][node[depth - k][first]] + w, out=best)
            cost.append(best)
            node.append(own)
            last = here[size[here] == depth]
            out[last] = best[own[last]] & ((1 << _COUNT) - 1)
        return out

    def counts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of tokens and of pre-tokens of the documents in buf."""
        start, end, first = pretokens(buf, off)
        if not len(start):
            return np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
        one, back = T.distinct(buf, start, end)
        words = T.cut_out(buf, start[one], end[one])
        n = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(n < 0)
        if len(new):
            fresh = [words[i] for i in new]
            n[new] = self.measure(fresh)
            if len(self.known) + len(new) > CACHED or self.held > CACHED_BYTES:
                self.known.clear()
                self.held = 0
            self.held += sum(map(len, fresh))
            self.known.update(zip(fresh, n[new].tolist(), strict=True))
        total = np.r_[0, np.cumsum(n[back])]
        return np.diff(total[first]), np.diff(first)


_loaded: dict[str, Unigram] = {}


def unigram(path: str) -> Unigram:
    """The model of a file, once in each worker."""
    if path not in _loaded:
        _loaded[path] = Unigram(path)
    return _loaded[path]


def with_token_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and n_pretokens. path: a file of ranks that every executor has."""
    text_at = docs.columns.index(text_col)
    passed = [i for i, c in enumerate(docs.columns) if c not in ("n_tokens", "n_pretokens")]

    def batches(it):
        for batch in it:
            buf, off = T.string_buffers(batch.column(text_at))
            model = unigram(path)
            found = [model.counts(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off)]
            made = [pa.array(np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64), pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in passed), *made], [*(batch.schema.names[i] for i in passed), "n_tokens", "n_pretokens"])

    schema = "".join(f"`{docs.columns[i]}` {docs.schema[i].dataType.simpleString()}, " for i in passed)
    return docs.mapInArrow(batches, f"{schema}n_tokens long, n_pretokens long")
