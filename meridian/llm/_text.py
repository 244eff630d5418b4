"""Vectorised helpers over UTF-8 bytes of Arrow string columns, used inside Spark tasks.

Words are the matches of ``[^\\x20\\x09-\\x0D]+``. A word is hashed eight bytes at a
time and a window by pairs of halves, with a mixing step after each; so no text has the
structure that makes sums of powers collide, and words of up to eight bytes collide with
none of their length. A second, independent hash comes with another ``kind``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
BLOCK = 1 << 18
_SEED = (U64(0), U64(0xD6E8FEB86659FD93))
_STEP = (U64(0x9E3779B97F4A7C15), U64(0xA0761D6478BD642F))
_WIDE = 64  # bytes; longer words are hashed one by one
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NO_LETTER = np.zeros(256, bool)  # ASCII without letters; all bytes of other characters belong to words
NO_LETTER[:0x80] = True
NO_LETTER[0x41:0x5B] = NO_LETTER[0x61:0x7B] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def string_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.large_string())
    arr = arr.cast(pa.large_binary() if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else pa.large_string())
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_large_binary(arr.type) else "")
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2] if len(arr) else None
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


class Words(NamedTuple):
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after it
    first: np.ndarray  # index of each document's first word; one more entry at the end


def words_of(buf: np.ndarray, off: np.ndarray, apart: np.ndarray = SPACE) -> Words:
    """The words of documents that lie one after another in buf; none crosses a document's end. apart: which bytes separate words."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(off), np.int64))
    solid = ~apart[buf]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    edge = off[:-1][off[:-1] < off[1:]]
    starts[edge] |= solid[edge]
    edge = edge[edge > 0] - 1
    ends[edge] |= solid[edge]
    s = np.flatnonzero(starts)
    return Words(s, np.flatnonzero(ends) + 1, np.searchsorted(s, off))


def loads(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of buf on, as one number; beyond the end there are zeros."""
    wide = np.zeros(len(buf) + 8, np.uint8)
    wide[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", wide, strides=(1,))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
    """A hash of buf[start:end] for each span."""
    out = np.empty(len(start), U64)
    eight = loads(buf)
    for lo in range(0, len(start), BLOCK):
        s, n = start[lo : lo + BLOCK], end[lo : lo + BLOCK] - start[lo : lo + BLOCK]
        h = mix((eight[s] & _MASK[np.minimum(n, 8)]) ^ _SEED[kind])
        more = np.flatnonzero((n > 8) & (n <= _WIDE))
        done = 8
        while len(more):
            left = n[more] - done
            h[more] = mix(h[more] * _STEP[kind] + (eight[s[more] + done] & _MASK[np.minimum(left, 8)]))
            done += 8
            more = more[left > 8]
        for i in np.flatnonzero(n > _WIDE).tolist():
            h[i] = xxhash.xxh3_64_intdigest(buf[s[i] : s[i] + n[i]].tobytes(), seed=kind)
        out[lo : lo + BLOCK] = mix(h ^ n.astype(U64) * U64(0x632BE59BD9B4E019))
    return out


def same_spans(buf: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Does buf hold the same size bytes from start on as from other on?"""
    eight = loads(buf)
    out = np.ones(len(start), bool)
    left, done = np.arange(len(start)), 0
    while len(left):
        own = np.minimum(size[left] - done, 8)
        out[left] &= (eight[start[left] + done] ^ eight[other[left] + done]) & _MASK[own] == 0
        done += 8
        left = left[(size[left] > done) & (size[left] <= _WIDE) & out[left]]
    for i in np.flatnonzero((size > _WIDE) & out).tolist():
        out[i] = np.array_equal(buf[start[i] : start[i] + size[i]], buf[other[i] : other[i] + size[i]])
    return out


def distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct word, and which of them each word is. Bytes are compared, not only hashes."""
    _, one, back = np.unique(span_hashes(buf, start, end), return_index=True, return_inverse=True)
    size, first = end - start, one[back]
    wrong = np.flatnonzero(size != size[first])
    if not len(wrong):
        wrong = np.flatnonzero(~same_spans(buf, start, size, start[first]))
    if len(wrong):  # two words with one hash
        names: dict[bytes, int] = {}
        back = np.array([names.setdefault(buf[a:b].tobytes(), len(names)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
        one = np.unique(back, return_index=True)[1]
    return one, back


def cut_out(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    data = buf.tobytes()
    return [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def _joined(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    return mix(a * _STEP[kind] + b + _SEED[kind])


def window_hashes(words: np.ndarray, width: int, kind: int = 0, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of words[i:i+width] for each i in 0..len-width (or for the given i).

    Windows of one, two, four and so on words are joined to the width, lowest power first.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    if at is not None and len(at) * width < 2 * n:
        out, step = np.empty(len(at), U64), max(1, BLOCK // width)
        for lo in range(0, len(at), step):
            own = words[at[lo : lo + step, None] + np.arange(width)]
            acc, used = None, 0
            for k in range(width.bit_length()):
                if width >> k & 1:
                    part = own[:, used : used + (1 << k)]
                    while part.shape[1] > 1:
                        part = _joined(part[:, ::2], part[:, 1::2], kind)
                    acc = part[:, 0] if acc is None else _joined(acc, part[:, 0], kind)
                    used += 1 << k
            out[lo : lo + step] = acc
        return out
    out = np.empty(n, U64)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        part, acc, used = words[lo : hi + width - 1], None, 0
        for k in range(width.bit_length()):
            if width >> k & 1:
                own = part[used : used + hi - lo]
                acc = own if acc is None else _joined(acc, own, kind)
                used += 1 << k
            if width >> k > 1:
                part = _joined(part[: -(1 << k)], part[1 << k :], kind)
        out[lo:hi] = acc
    return out if at is None else out[at]


def inside(first: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """For each window start 0..n_words-width: does the window lie in one document?"""
    n = n_words - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n_words + 1, np.int8)
    for k in range(1, width):  # the last width-1 starts before each document's end don't fit
        p = first[1:] - k
        ok[p[p >= 0]] = 0
    ok = ok[:n].astype(bool)
    # a short document's predecessor is already marked by its own end, so nothing else is to do
    return ok


def covered(n_words: int, starts: np.ndarray, width: int) -> np.ndarray:
    """The words that lie in a window which begins at one of starts."""
    d = np.zeros(n_words + 1, np.int32)
    d[: len(d)] += np.bincount(starts, minlength=n_words + 1).astype(np.int32)[: n_words + 1]
    e = starts + width
    d -= np.bincount(e, minlength=n_words + 1).astype(np.int32)[: n_words + 1]
    return np.cumsum(d[:-1]) > 0


def kept_text(buf: np.ndarray, off: np.ndarray, w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of each document's kept words, joined by one space."""
    if not keep.any():
        return np.zeros(0, np.uint8), np.zeros(len(off), np.int64)
    take = ~SPACE[buf]
    gone = np.flatnonzero(~keep)
    if len(gone):
        cut = np.flatnonzero(np.diff(gone) > 1)
        for a, b in zip(gone[np.r_[0, cut + 1]], gone[np.r_[cut, len(gone) - 1]], strict=True):
            take[w.start[a] : w.end[b]] = False
    k = np.flatnonzero(keep)
    doc = np.searchsorted(w.first, k, "right") - 1
    sep = w.end[k[:-1]][doc[:-1] == doc[1:]]  # the white space after a kept word that another follows
    take[sep] = True
    n = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(take, out=n[1:])
    out = buf[take]
    out[n[sep]] = 0x20
    return out, n[off]


def to_strings(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(buf)))


def to_binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def pieces(buf: np.ndarray, off: np.ndarray, block: int, apart: np.ndarray = NO_LETTER):
    """Blocks of whole tokens: (first document, offsets of the pieces). They are whole documents, or a part of one that is longer than a block."""
    doc, at, n = 0, 0, len(off) - 1
    while doc < n:
        cuts, first, part = [at], doc, at > off[doc]
        while doc < n and off[doc + 1] - cuts[0] <= block and not (part and len(cuts) == 2):
            cuts.append(int(off[doc + 1]))
            doc += 1
        if len(cuts) == 1:  # longer than a block: cut between two tokens
            end, size = int(off[doc + 1]), block
            while True:
                gaps = np.flatnonzero(apart[buf[at + size // 2 : min(end, at + size)]])
                if len(gaps) or at + size >= end:
                    break
                size *= 2
            cut = at + size // 2 + int(gaps[-1]) + 1 if at + size < end else end
            cuts.append(cut)
            doc += cut == end
        at = cuts[-1]
        yield first, np.array(cuts, np.int64)


def spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """buf[start:end] of each span as strings, without Python objects."""
    size = end - start
    off = np.r_[0, np.cumsum(size)]
    return to_strings(buf[np.repeat(start - off[:-1], size) + np.arange(off[-1])], off)
