"""Substring dedup: passages that occur earlier in the corpus are removed, found by level-wise doubling.

A window of ``min_words`` words can only repeat if its first and last halves
repeat. So windows are counted at a short length first; only windows whose two
overlapping halves repeat are hashed at (up to) twice the length, and so on up to
``min_words``. Documents stay where they are, dealt into chunks by id. Each level
sends every distinct window hash of a chunk once to the bucket of that hash; the
bucket answers with one bit per hash. A window that is everywhere thus costs one
row entry per chunk, never a list of its places, and no task gathers a window's
occurrences. At the last level the bits say whether the chunk holds the window's
first occurrence; hashes have 128 bits there, from two independent hashes of the words.

A level has as many messages as chunks times buckets, which is the number of blocks of
any shuffle between as many tasks; past some thousand tasks take more cores a task and
larger partitions, since a message then holds few hashes.

Cases: null or blank texts have no words and stay blank; a null id sorts first;
rows that share an id (or have none) are separate documents, ordered by a hash of their
texts and dealt apart; identical rows are ordered arbitrarily among themselves, so that
one of them keeps the passage. Every input row gives one output row. Other columns pass
unchanged; added columns take the place of existing ones with their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm import _text as T
from meridian.llm._io import chunked, partitions

ASK, KEEP = 0, 1
ADDED = ("n_words", "n_removed", "kept_text")
MAIL = "chunk int, bucket int, kind int, data binary"
_SCHEMA = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def levels(min_words: int, shortest: int = 5) -> list[int]:
    """Window lengths from the first level to the last; each is at most twice the one before."""
    out = [min_words]
    while out[0] > shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


class _Chunk:
    """A chunk's documents in order, with their words hashed."""

    def __init__(self, docs: pa.Table):
        docs = docs.take(pc.sort_indices(docs.select(["id", "tie"]), sort_keys=[("id", "ascending"), ("tie", "ascending")], null_placement="at_start"))
        self.ids = docs["id"]
        self.rest = docs["rest"] if "rest" in docs.column_names else None
        self.rank = np.asarray(pc.fill_null(docs["id"].combine_chunks(), -(2**63)))
        self.tie = np.asarray(docs["tie"].combine_chunks())
        self.texts = docs["text"]
        self.buf, self.off = T.string_buffers(self.texts)
        self._hash()

    def _hash(self):
        pa.default_memory_pool().release_unused()  # what the groups before have left
        self.words = T.words_of(self.buf, self.off)
        self.n = len(self.words.start)
        self.hashes = T.span_hashes(self.buf, self.words.start, self.words.end)

    def both(self, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows at the given starts."""
        own = np.flatnonzero(T.covered(self.n, at, width))
        other = np.zeros(self.n, np.uint64)
        other[own] = T.span_hashes(self.buf, self.words.start[own], self.words.end[own], 1)
        return T.window_hashes(self.hashes, width, 0, at), T.window_hashes(other, width, 1, at)


def _first_level(chunk: _Chunk, width: int) -> np.ndarray:
    return np.flatnonzero(T.inside(chunk.words.first, chunk.n, width))


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket above, 32 bits of the hash below: buckets grow with the corpus, and so do the bits in all."""
    return (h >> T.U64(32)) % T.U64(buckets) << T.U64(32) | h & T.U64(0xFFFFFFFF)


def _mail(chunk: int, rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([chunk] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], schema=_SCHEMA)


def _split(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys."""
    b = (keys >> T.U64(32)).astype(np.int64)
    cut = np.r_[0, np.flatnonzero(np.diff(b)) + 1, len(b)] if len(b) else np.zeros(1, np.int64)
    return [(int(b[i]), int(i), int(j)) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _state(at: np.ndarray, n: int) -> bytes:
    flags = np.zeros(n, bool)
    flags[at] = True
    return np.packbits(flags).tobytes()


def _ask(chunk_no: int, chunk: _Chunk, at: np.ndarray, width: int, buckets: int) -> pa.Table:
    """One entry for each distinct candidate window of this length, and the candidates themselves for later."""
    keys = np.unique(_keys(T.window_hashes(chunk.hashes, width, at=at), buckets))
    rows = [(b, ASK, (keys[i:j] & T.U64(0xFFFFFFFF)).astype(np.uint32).tobytes()) for b, i, j in _split(keys)]
    return _mail(chunk_no, [*rows, (chunk_no % buckets, KEEP, _state(at, chunk.n))])


def _answers(chunk: _Chunk, mail: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The candidates of the level before, and the bits that came back, in the order of the keys."""
    kinds, buckets, data = np.asarray(mail["kind"]), np.asarray(mail["bucket"]), mail["data"].to_pylist()
    at = next((np.flatnonzero(np.unpackbits(np.frombuffer(d, np.uint8), count=chunk.n)) for k, d in zip(kinds, data, strict=True) if k == KEEP), np.zeros(0, np.int64))
    bits = [np.frombuffer(data[i], np.uint8) for i in sorted(np.flatnonzero(kinds == ASK), key=lambda i: buckets[i])]
    return at, np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)


def _repeated(chunk: _Chunk, mail: pa.Table, width: int, buckets: int) -> np.ndarray:
    """Candidates that occur twice or more, here or in another chunk."""
    at, bits = _answers(chunk, mail)
    if not len(at):
        return at
    keys, back, count = np.unique(_keys(T.window_hashes(chunk.hashes, width, at=at), buckets), return_inverse=True, return_counts=True)
    return at[(bits | (count > 1))[back]]


def _extended(at: np.ndarray, width: int, longer: int, chunk: _Chunk) -> np.ndarray:
    """Starts whose window of the longer length begins and ends with a repeated one, within one document."""
    flags = np.zeros(chunk.n + longer, bool)
    flags[at] = True
    at = at[flags[at + (longer - width)]]
    doc = np.searchsorted(chunk.words.first, at, "right")
    return at[doc == np.searchsorted(chunk.words.first, at + longer - 1, "right")]


def _full_keys(chunk: _Chunk, at: np.ndarray, width: int, buckets: int):
    """Sorted distinct 128-bit hashes of the last level: bucket, both halves, the first start of each, and the way back."""
    a, b = chunk.both(at, width)
    bucket = (a >> T.U64(32)) % T.U64(buckets)
    order = np.lexsort((at, b, a, bucket))
    new = np.ones(len(at), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    back = np.empty(len(at), np.int64)
    back[order] = np.cumsum(new) - 1
    head = order[new]
    return bucket[head], a[head], b[head], head, back


def _last_ask(chunk_no: int, chunk: _Chunk, at: np.ndarray, width: int, buckets: int) -> pa.Table:
    bucket, a, b, head, _ = _full_keys(chunk, at, width, buckets)
    doc = np.searchsorted(chunk.words.first, at[head], "right") - 1
    rank, tie = chunk.rank[doc].view(np.uint64), chunk.tie[doc].view(np.uint64)
    rows = [(k, ASK, np.concatenate([x[i:j] for x in (a, b, rank, tie)]).tobytes()) for k, i, j in _split(bucket << T.U64(32))]
    return _mail(chunk_no, [*rows, (chunk_no % buckets, KEEP, _state(at, chunk.n))])


def _removed(chunk: _Chunk, mail: pa.Table, width: int, buckets: int) -> np.ndarray:
    """The words to remove: those in a window that is not the first of its kind."""
    at, bits = _answers(chunk, mail)
    if not len(at):
        return np.zeros(chunk.n, bool)
    _, _, _, head, back = _full_keys(chunk, at, width, buckets)
    later = np.ones(len(at), bool)
    later[head[bits]] = False
    return T.covered(chunk.n, at[later], width)


def _runs(mail: pa.Table, kinds: np.ndarray) -> tuple[list[int], list[bytes]]:
    rows = np.flatnonzero(kinds == ASK)
    return rows, [mail["data"][int(i)].as_py() for i in rows]


def _replied(mail: pa.Table, answer) -> pa.Table:
    """The bucket's answers; what a chunk keeps for itself goes back unchanged."""
    kinds = np.asarray(mail["kind"])
    rows, asked = _runs(mail, kinds)
    data = mail["data"].to_pylist()
    for i, bits in zip(rows, answer(asked), strict=True):
        data[i] = bits
    return pa.table([mail["chunk"], mail["bucket"], mail["kind"], pa.array(data, pa.binary())], schema=_SCHEMA)


def _count(asked: list[bytes]) -> list[bytes]:
    """For each hash: did two chunks or more send it?"""
    parts = [np.frombuffer(x, np.uint32) for x in asked]
    if not parts:
        return []
    _, back, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    return [x.tobytes() for x in np.split((count > 1)[back].astype(np.uint8), np.cumsum([len(x) for x in parts])[:-1])]


def _first(asked: list[bytes]) -> list[bytes]:
    """For each hash: does this chunk hold its first document?"""
    parts = [np.frombuffer(x, np.uint64).reshape(4, -1) for x in asked]
    if not parts:
        return []
    a, b, rank, tie = (np.concatenate([p[k] for p in parts]) for k in range(4))
    order = np.lexsort((tie.view(np.int64), rank.view(np.int64), b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    first = np.zeros(len(a), np.uint8)
    first[order[new]] = 1
    return [x.tobytes() for x in np.split(first, np.cumsum([p.shape[1] for p in parts])[:-1])]


def remove_repeats(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """docs (id_col as a long; without text_col unless with_text) with n_words, n_removed and kept_text: every document without the words of repeated windows of min_words words.

    A window goes if its words also start earlier, in a smaller id or earlier in the
    same document. Windows are judged on the input.
    """
    buckets = (partitions(docs.sparkSession) + 1) // 2  # with twice as many chunks as partitions, messages number partitions**2 a level
    sizes = levels(min_words)
    docs = docs.drop(*(c for c in ADDED if c not in (id_col, text_col)))
    parts = chunked(docs, id_col, text_col, ["id", "text"], rest=True)
    rest = parts.schema["rest"].dataType if "rest" in parts.columns else None

    def start(key, docs):
        chunk = _Chunk(docs)
        ask = _last_ask if len(sizes) == 1 else _ask
        return ask(key[0].as_py(), chunk, _first_level(chunk, sizes[0]), sizes[0], buckets)

    def extend(k):
        def level(key, docs, mail):
            chunk = _Chunk(docs)
            at = _extended(_repeated(chunk, mail, sizes[k - 1], buckets), sizes[k - 1], sizes[k], chunk)
            ask = _last_ask if k == len(sizes) - 1 else _ask
            return ask(key[0].as_py(), chunk, at, sizes[k], buckets)

        return level

    def reply(answer):
        return lambda mail: _replied(mail, answer)

    for k in range(len(sizes)):
        asked = parts.groupBy("chunk").cogroup(mail.groupBy("chunk")).applyInArrow(extend(k), MAIL) if k else parts.groupBy("chunk").applyInArrow(start, MAIL)
        mail = asked.groupBy("bucket").applyInArrow(reply(_first if k == len(sizes) - 1 else _count), MAIL)

    def finish(key, docs, mail):
        chunk = _Chunk(docs)
        gone = _removed(chunk, mail, sizes[-1], buckets)
        w = chunk.words
        total = np.r_[0, np.cumsum(gone)]
        kept, off = T.kept_text(chunk.buf, chunk.off, w, ~gone)
        out = {"id": chunk.ids, "n_words": np.diff(w.first), "n_removed": np.diff(total[w.first]), "kept_text": T.to_strings(kept, off).cast(pa.string())}
        if with_text:
            out["text"] = chunk.texts
        if chunk.rest is not None:
            out["rest"] = chunk.rest
        return pa.table(out)

    schema = "id long, n_words long, n_removed long, kept_text string" + ", text string" * with_text + (f", rest {rest.simpleString()}" if rest else "")
    out = parts.groupBy("chunk").cogroup(mail.groupBy("chunk")).applyInArrow(finish, schema)
    others = [F.col(f"rest.`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    return out.select(F.col("id").alias(id_col), *([F.col("text").alias(text_col)] if with_text else []), *others, *ADDED)
