"""Token-ID output: a content-addressed store of token-id chunks with recipes and Merkle roots.

Layout under a folder, all Parquet:

* ``objects/kind=chunk``: digest (SHA-256 of data), data: ids as little-endian
  unsigned integers of ``width`` bytes. Every distinct chunk is stored once.
* ``recipes``: one row per document in ascending order of id: doc_id, start (ids of all
  documents before it), n_tokens, chunks (the digests in order), sizes, root (Merkle root
  over the digests), part (which run of documents).
* ``manifest``: for each part the number of documents and ids and the Merkle root over
  its documents (place, id, length and root of each).
* ``head``: one row: width, parts, documents, tokens, and the Merkle root over the parts.

Id streams are cut where a rolling hash over the last 16 ids meets a mask, so equal
passages give equal chunks wherever they stand. Chunks are deduplicated inside each
task before they are shuffled by digest; recipes carry digests only. Reading goes down
the whole tree: the head against the manifest, the manifest against the recipes, every
recipe against its root and sizes, every chunk against its digest. Anything missing,
changed or in another place is an error.

Cases: a null text counts as empty, so its stream is the end id alone; a null id sorts
first; rows that share an id are separate documents in the order of their roots; one
recipe for each input row, repeated rows too; an empty table gives empty files. Extra
columns are not stored.
"""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.llm import _text as T
from meridian.llm._cache import IdCache
from meridian.llm._io import hot_keys, looked_up, partitions, written
from meridian.llm.byte_bpe import slices

SPAN, MEAN, SHORTEST, LONGEST = 16, 512, 32, 4096
OBJECTS = "key int, kind string, tie int, digest binary, data binary, doc_id long, n_tokens long, chunks array<binary>, sizes array<int>, root binary"
_GEAR = T.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * T.U64(0x9E3779B97F4A7C15))
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(x) for x in '!"#$%&()*+,-./:;=?@[]^_`{}~']] = True
_TOGETHER = 4096
_open: dict[str, tuple] = {}


def _tokenizer(path: str):
    """The tokenizer and the ids of words seen, once in each worker."""
    if path not in _open:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        _open[path] = tok, IdCache(dtype=np.uint16 if tok.get_vocab_size() <= 1 << 16 else np.uint32)
    return _open[path]


def _letters(buf: np.ndarray) -> np.ndarray:
    """Bytes that end an ASCII letter or digit, or one of the letters U+00C0 to U+024F (those of two bytes led by C3 to C9)."""
    out = _ALNUM[buf]
    lead = buf[:-1]
    # Not the signs U+00D7 and U+00F7, nor U+0130, whose lower case ends in a combining mark.
    pair = (lead >= 0xC3) & (lead <= 0xC9) & ~((lead == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))) & ~((lead == 0xC4) & (buf[1:] == 0xB0))
    out[1:] |= pair
    return out


def pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, T.Words]:
    """Bytes with ASCII in lower case, and the pieces of the texts in them that can be encoded apart.

    The tokenizer ignores case, ends a pre-token at white space, and begins a new one
    where a mark follows a letter or digit. Words with "<" stay whole and as they are:
    a special token may be in them.
    """
    w = T.words_of(buf, off)
    low = T.LOWER[buf]
    cut = np.zeros(len(buf), bool)
    cut[1:] = _letters(buf)[:-1] & _MARK[buf[1:]]
    for a in np.unique(np.searchsorted(w.start, np.flatnonzero(buf == 0x3C), "right") - 1):
        low[w.start[a] : w.end[a]] = buf[w.start[a] : w.end[a]]
        cut[w.start[a] : w.end[a]] = False
    at = np.flatnonzero(cut)
    start, end = np.sort(np.r_[w.start, at]), np.sort(np.r_[w.end, at])
    return low, T.Words(start, end, np.searchsorted(start, off))


def _encoded_words(tok, words: list[bytes], dtype) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of the words, and the number for each. Many go through the library as one text, with a special token between them; words with "<" go alone."""
    gap = next((t for t in tok.get_added_tokens_decoder().items() if t[1].special and not t[1].normalized), None)
    alone = np.array([gap is None or b"<" in x for x in words], bool)
    n = np.zeros(len(words), np.int64)
    parts: dict[int, np.ndarray] = {}
    together = np.flatnonzero(~alone)
    for lo in range(0, len(together), _TOGETHER):
        part = together[lo : lo + _TOGETHER]
        text = gap[1].content.encode().join([words[i] for i in part]).decode()
        ids = np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        at = np.flatnonzero(ids == gap[0])
        n[part] = np.diff(np.r_[-1, at, len(ids)]) - 1
        parts[int(part[0])] = ids[ids != gap[0]].astype(dtype)
    single = {int(i): np.array(e.ids, dtype) for i, e in zip(np.flatnonzero(alone), tok.encode_batch_fast([words[i].decode() for i in np.flatnonzero(alone)], add_special_tokens=False), strict=True)}
    for i, x in single.items():
        n[i] = len(x)
    to = np.r_[0, np.cumsum(n)]
    out = np.zeros(to[-1], dtype)
    own = np.repeat(alone, n)
    out[~own] = np.concatenate([np.zeros(0, dtype), *parts.values()])
    out[own] = np.concatenate([np.zeros(0, dtype), *single.values()])
    return out, n


def encode(path: str, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the documents in buf and their offsets; a distinct piece is encoded once."""
    tok, cache = _tokenizer(path)
    buf, w = pieces(buf, off) if len(buf) else (buf, T.words_of(buf, off))
    if not len(w.start):
        return np.zeros(0, cache.dtype), np.zeros(len(off), np.int64)
    one, back = T.distinct(buf, w.start, w.end)
    words = T.cut_out(buf, w.start[one], w.end[one])
    ids, to = cache.join(cache.slots(words, lambda new: _encoded_words(tok, [words[i] for i in new], cache.dtype))[back])
    return ids, to[w.first]


def cuts(ids: np.ndarray) -> list[int]:
    """The ends of the chunks of one document's stream."""
    h = _GEAR[ids & 0xFFFF]
    k = 1
    while k < SPAN:  # h[i] covers the 2k ids up to i
        h[k:] = h[k:] + (h[:-k] << T.U64(k))
        k *= 2
    marks = np.flatnonzero((h >> T.U64(20)) % T.U64(MEAN) == 0) + 1
    out, last = [], 0
    for m in [*marks.tolist(), len(ids)]:
        while m - last > LONGEST:
            last += LONGEST
            out.append(last)
        if m - last >= SHORTEST or m == len(ids) and m > last:
            out.append(m)
            last = m
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256; an odd node moves up as it is."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(level) & ~1 :]
    return level[0]


def _encoded(it, path: str, end_id: int, keys: int):
    """A chunk row for each digest that is new to this task, and a recipe row for each document."""
    sent: set[bytes] = set()
    turn = None
    for batch in it:
        buf, off = T.string_buffers(batch.column(1))
        doc_ids = batch.column(0).to_pylist()
        for i, j in slices(off, 2 << 20):
            rows = {n: [] for n in ("key", "kind", "tie", "digest", "data", "doc_id", "n_tokens", "chunks", "sizes", "root")}

            def add(rows=rows, **x):
                for n, v in rows.items():
                    v.append(x.get(n))

            ids, to = encode(path, buf[off[i] : off[j]], off[i : j + 1] - off[i])
            for d in range(j - i):
                own = np.append(ids[to[d] : to[d + 1]], ids.dtype.type(end_id))
                ends = cuts(own)
                digests = []
                stream, wide = own.astype(own.dtype.newbyteorder("<")).tobytes(), own.itemsize
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    data = stream[wide * a : wide * b]
                    digests.append(digest := hashlib.sha256(data).digest())
                    if digest not in sent:
                        if len(sent) >= 1 << 18:  # what is sent twice is dropped after the shuffle
                            sent.clear()
                        sent.add(digest)
                        add(key=int.from_bytes(digest[:4], "little") % keys, kind="chunk", digest=digest, data=data)
                # Recipes are dealt in turn: many documents may be alike, or have no id.
                turn = (zlib.crc32(digests[0]) if turn is None else turn + 1) % keys
                add(key=turn, kind="recipe", tie=turn, doc_id=doc_ids[i + d], n_tokens=len(own), chunks=digests, sizes=[b - a for a, b in zip([0, *ends[:-1]], ends, strict=True)], root=merkle(digests))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()), strict=True)], list(rows))


def _once(it):
    """Drops a chunk that follows itself; rows come sorted by digest, recipes have none."""
    last = None
    for batch in it:
        keep = []
        for kind, digest in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            keep.append(kind == "recipe" or digest != last)
            last = digest
        yield batch.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenises docs and writes the store. tokenizer_path: a file that every executor has."""
    spark = docs.sparkSession
    p = partitions(spark)
    made = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lambda it: _encoded(it, tokenizer_path, end_id, 1 << 20), OBJECTS)
    made = made.repartition(p, "key").sortWithinPartitions("kind", "digest").mapInArrow(_once, OBJECTS)
    made.drop("key").write.option("compression", "snappy").option("parquet.enable.dictionary", "false").partitionBy("kind").parquet(f"{folder}/objects")

    objects = spark.read.schema("tie int, digest binary, data binary, doc_id long, n_tokens long, chunks array<binary>, sizes array<int>, root binary, kind string").parquet(f"{folder}/objects")
    found = objects.filter("kind = 'recipe'").select("doc_id", "n_tokens", "chunks", "sizes", "root", "tie")
    order = [F.asc_nulls_first("doc_id"), F.col("root"), F.col("tie")]
    dealt = found.repartitionByRange(p, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    dealt.write.option("compression", "zstd").parquet(f"{folder}/unplaced")
    # Parts are runs of ids in order; the sums of all parts before give where each begins.
    parts = spark.read.parquet(f"{folder}/unplaced")
    totals = parts.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"), F.count("*").alias("part_documents"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("part_start", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(totals, "part").withColumn("start", F.col("part_start") + F.col("inside"))
    placed = placed.select("doc_id", "start", "n_tokens", "chunks", "sizes", "root", "part").sortWithinPartitions("start")
    placed.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    _part_roots(spark.read.parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")
    _head(spark.read.parquet(f"{folder}/manifest"), _width(tokenizer_path)).write.parquet(f"{folder}/head")


def _width(tokenizer_path: str) -> int:
    """Bytes of a stored id."""
    return _tokenizer(tokenizer_path)[1].ids.itemsize


PARTS, HEAD = "part int, documents long, tokens long, pieces long, start long, root binary", "width int, parts long, documents long, tokens long, pieces long, root binary"
_SUMS = ("documents", "tokens", "pieces")


def _part_roots(recipes: DataFrame) -> DataFrame:
    """Documents, ids, place and Merkle root of each part; a part is one run of the range partitioning, and holds some of the documents only."""

    def root(rows):
        rows = rows.sort_by("start")
        leaves = [hashlib.sha256(f"{s} {d} {n} ".encode() + r).digest() for s, d, n, r in zip(*(rows[c].to_pylist() for c in ("start", "doc_id", "n_tokens", "root")), strict=True)]
        return pa.table({"part": rows["part"][:1], "documents": [len(rows)], "tokens": [sum(rows["n_tokens"].to_pylist())], "pieces": [sum(rows["pieces"].to_pylist())], "start": rows["start"][:1], "root": pa.array([merkle(leaves)], pa.binary())})

    return recipes.select("part", "start", "doc_id", "n_tokens", "root", F.size("sizes").cast("long").alias("pieces")).groupBy("part").applyInArrow(root, PARTS)


def _head(parts: DataFrame, width: int) -> DataFrame:
    """One row over all parts, of which there are as many as partitions."""
    leaf = F.sha2(F.concat_ws(" ", "part", *_SUMS, "start", F.hex("root")), 256)
    every = parts.agg(F.lit(width).alias("width"), F.count("*").alias("parts"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS), F.sort_array(F.collect_list(F.struct("part", leaf.alias("leaf")))).alias("leaves"))

    def root(it):
        for batch in it:
            roots = [merkle([bytes.fromhex(x["leaf"]) for x in leaves]) for leaves in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(roots, pa.binary())], ["width", "parts", *_SUMS, "root"])

    return every.mapInArrow(root, HEAD)


def _checked_head(spark: SparkSession, folder: str, recipes: DataFrame) -> tuple[int, int]:
    """The width of the store's ids and the number of pieces in all recipes; an error where head, manifest and recipes don't agree."""
    parts = spark.read.schema(PARTS).parquet(f"{folder}/manifest")
    head = spark.read.schema(HEAD).parquet(f"{folder}/head").first()
    if head is None or head != _head(parts, head["width"]).first():
        raise ValueError(f"the manifest of {folder} does not match its head")
    same = F.expr("a.documents <=> b.documents and a.tokens <=> b.tokens and a.pieces <=> b.pieces and a.start <=> b.start and a.root <=> b.root")
    wrong = parts.alias("a").join(_part_roots(recipes).alias("b"), "part", "full").filter(~same).select("part").limit(5).collect()
    if wrong:
        raise ValueError(f"recipes of {folder} do not match its manifest, in parts {sorted(r['part'] for r in wrong)}")
    return head["width"], head["pieces"]


_POLY = 0xEDB88320


def _shifts(levels: int = 40) -> np.ndarray:
    """tables[k, byte, value]: what 2**k zero bytes make of a CRC-32 with only that byte set."""

    def once(m: list[int], v: int) -> int:
        out = 0
        for i in range(32):
            if v >> i & 1:
                out ^= m[i]
        return out

    bit = [_POLY if i == 0 else 1 << (i - 1) for i in range(32)]
    for _ in range(3):
        bit = [once(bit, x) for x in bit]
    out = np.zeros((levels, 4, 256), np.uint32)
    for k in range(levels):
        for j in range(4):
            for v in range(256):
                out[k, j, v] = once(bit, v << 8 * j)
        bit = [once(bit, x) for x in bit]
    return out


_tables: list[np.ndarray] = []


def joined_crc32(crc: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of each document from those of its pieces. first: index of each document's first piece, and the end."""
    if not _tables:
        _tables.append(_shifts())
    total = np.r_[0, np.cumsum(length)]
    behind = np.repeat(total[first[1:]], np.diff(first)) - total[1:]
    c = crc.astype(np.uint32)
    for k, t in enumerate(_tables[0]):
        at = np.flatnonzero(behind >> k & 1)
        if len(at):
            x = c[at]
            c[at] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
    return np.bitwise_xor.reduceat(c, first[:-1]) if len(first) > 1 else c[:0]


def _checked(it, width: int):
    """Digest, size and CRC-32 (of 32-bit ids) of each stored chunk; wrong content is an error."""
    for batch in it:
        digests, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        size, crc = [], []
        for digest, x in zip(digests, data, strict=True):
            if hashlib.sha256(x).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} is damaged")
            size.append(len(x) // width)
            crc.append(zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), pa.array(crc, pa.int64())], ["digest", "size", "crc"])


def _verified(it):
    """A document's CRC-32 from its chunks in order; a missing chunk, wrong size or wrong root is an error."""
    for batch in it:
        lists = batch.column(4).to_pylist()
        sizes, crcs, n = [], [], []
        for x, total, root in zip(lists, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if merkle([c["digest"] for c in x]) != root or sum(c["size"] for c in x) != total:
                raise ValueError("a recipe does not match its chunks")
            n.append(len(x))
            sizes += [4 * c["size"] for c in x]
            crcs += [c["crc"] for c in x]
        crc = joined_crc32(np.array(crcs, np.uint32), np.array(sizes, np.int64), np.r_[0, np.cumsum(n)].astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    chunks = spark.read.schema("digest binary, data binary, kind string").parquet(f"{folder}/objects").filter("kind = 'chunk'").select("digest", "data")
    return chunks, spark.read.schema("doc_id long, start long, n_tokens long, chunks array<binary>, sizes array<int>, root binary, part int").parquet(f"{folder}/recipes")


def verify_store(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files. Chunks stay where they are; sizes and checksums go to the recipes."""
    chunks, recipes = _read(spark, folder)
    width, pieces = _checked_head(spark, folder, recipes)
    # Every chunk is read and hashed once; what is known of it then is a few bytes.
    facts = written(chunks.mapInArrow(lambda it: _checked(it, width), "digest binary, size int, crc long"), "chunk-facts")
    steps = recipes.select("start", F.posexplode("chunks").alias("seq", "digest"))
    # A chunk that is in very many documents is not gathered.
    hot = hot_keys(steps.groupBy("digest").agg(F.count("*").alias("rows")), "digest", pieces)
    found = looked_up(steps, facts, "digest", hot)
    known = found.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("seq", "digest", "size", "crc"))).alias("found"))
    whole = recipes.select("doc_id", "start", "n_tokens", "root").join(known, "start", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<seq:int,digest:binary,size:int,crc:bigint>>")))
    return whole.select("doc_id", "start", "n_tokens", "root", "found").mapInArrow(_verified, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) with every document put together again from its chunks, all of it verified."""
    chunks, recipes = _read(spark, folder)
    width, _ = _checked_head(spark, folder, recipes)
    steps = recipes.select("start", F.posexplode("chunks").alias("seq", "digest")).join(chunks, "digest")
    lists = steps.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("found"))
    rows = recipes.select("doc_id", "start", "n_tokens", "root").join(lists, "start", "left").select("doc_id", "start", "n_tokens", "root", F.col("found.data").alias("data"))

    def whole(it):
        for batch in it:
            ids = []
            for n, root, data in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                own = np.frombuffer(b"".join(data or []), f"<u{width}")
                if len(own) != n or merkle([hashlib.sha256(x).digest() for x in data or []]) != root:
                    raise ValueError("a document does not match its recipe")
                ids.append(own.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return rows.mapInArrow(whole, "doc_id long, start long, ids array<int>")
