"""Awkward rows through every operator: nulls in any column, repeated rows, clashing columns, very long texts, words made to collide."""

import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from meridian.llm import _text as T
from meridian.llm import byte_bpe, graph_index, language_id, mixing, quality_rules, token_counts, token_store, warc
from meridian.llm.byte_bpe import encode_decode
from meridian.llm.jaccard_join import near_duplicates
from meridian.llm.substring_dedup import remove_repeats

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string, n_words string, id string, chunk string, token string"


def thue_morse(letters: str, size: int = 2048) -> str:
    return "".join(letters[bin(i).count("1") & 1] for i in range(size))


ONE, TWO = thue_morse("ab"), thue_morse("ba")


def awkward(spark):
    same = "the same words stand here in both rows and the rest of it too so that they are alike in all"
    rows = [
        (1, same, "en", "s1"), (1, same, "en", "s1"), (1, None, "en", "s1"), (None, same, None, None), (None, same, None, None), (None, "other", "de", "s2"),
        (2, "", None, "s1"), (3, " \n\t ", "", ""), (4, "x", "en", None), (5, None, None, None),
    ]
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)


def count(df):
    return Counter(map(str, (r["doc_id"] for r in df.collect())))


def test_hashes_of_words_made_to_collide():
    buf = np.frombuffer(f"{ONE} {TWO} {ONE}".encode(), np.uint8)
    w = T.words_of(buf, np.array([0, len(buf)]))
    for kind in (0, 1):
        h = T.span_hashes(buf, w.start, w.end, kind)
        assert h[0] == h[2] != h[1]
    one, back = T.distinct(buf, w.start, w.end)
    assert one.tolist() == [0, 1] or back[0] == back[2] != back[1]
    a, b = (T.span_hashes(np.frombuffer(x.encode(), np.uint8), np.arange(2048), np.arange(1, 2049)) for x in (ONE, TWO))
    assert T.window_hashes(a, 2048)[0] != T.window_hashes(b, 2048)[0]


def test_words_with_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(T, "span_hashes", lambda buf, start, end, kind=0: np.zeros(len(start), np.uint64))
    words = [b"ab", b"cd", b"ab", b"abcdefghi", b"abcdefghj", b"x" * 100, b"x" * 99 + b"y", b"cd"]
    buf = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(x) for x in words])
    one, back = T.distinct(buf, end - [len(x) for x in words], end)
    assert [words[one[k]] for k in back] == words and len(one) == 6


def test_words_made_to_collide(spark):
    from tokenizers import Tokenizer

    nineteen = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{ONE} {nineteen}"), (2, f"{TWO} {nineteen}"), (3, ONE), (4, TWO)], "doc_id long, text string")
    assert {r["n_removed"] for r in remove_repeats(df).collect()} == {0}
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df.filter("doc_id > 2")).collect()}
    assert got == {3: 3, 4: 4}
    tok = Tokenizer.from_file(WORDS)
    for i, text in ((3, ONE), (4, TWO)):
        buf = np.frombuffer(text.encode(), np.uint8)
        assert token_store.encode(WORDS, buf, np.array([0, len(buf)]))[0].tolist() == tok.encode(text, add_special_tokens=False).ids
    model = token_counts.Unigram(RANKS)
    each = [int(model.measure([x.encode()])[0]) for x in (ONE, TWO)]
    both = np.frombuffer((ONE + " " + TWO).encode(), np.uint8)
    assert model.counts(both, np.array([0, 2048, len(both)]))[0].tolist() == [each[0], model.measure([b" " + TWO.encode()])[0]]


def test_byte_bpe(spark):
    df = awkward(spark)
    out = encode_decode(df, RANKS)
    assert set(out.columns) == {*df.columns, "ids_sha256", "decoded_sha256", "ids", "decoded"} and count(out) == count(df)
    assert all(r["decoded"] == (r["text"] or "") and len(r["ids"]) == r["n_tokens"] and r["source"] in ("s1", "s2", "", None) for r in out.collect())


def test_long_pretokens_by_a_heap():
    import base64

    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
    table, r = byte_bpe.ranks(RANKS), np.random.default_rng(2)
    texts = ["".join(r.choice(list(letters), n)) for letters, n in (("aetnoshr", 3000), ("ther", 2000), ("x", 5000), ("ab", 700))] + ["therehere" * 300, "=" * 900, "ü" * 600, "short"]
    data = [x.encode() for x in texts]
    end = np.cumsum([len(x) for x in data])
    ids, n = table.merge(np.frombuffer(b"".join(data), np.uint8), end - [len(x) for x in data], end)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [enc.encode_ordinary(x) for x in texts]


def test_substring_dedup(spark):
    words = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, words, "a"), (None, words, "b"), (None, words + " tail", "c"), (7, words, "d"), (7, "x " + words, "e")], "doc_id long, text string, tie string")
    got = {r["tie"]: r["n_removed"] for r in remove_repeats(df).collect()}
    # Of the three without an id one keeps the passage; all that have an id come later.
    assert sorted(got[x] for x in "abc") == [0, 40, 40] and got["d"] == got["e"] == 40
    assert count(remove_repeats(awkward(spark))) == count(awkward(spark))


def test_source_mixing(spark):
    df = awkward(spark)
    out = mixing.mix(df, {"lang": F.col("lang"), "source": F.col("source")}, {}, 100, 1)
    # A leaf without tokens, that of document 2, takes no part.
    assert count(out) == count(df.filter("not doc_id <=> 2")) and {r["id"] for r in out.collect()} == {"c"}
    assert mixing.mix(df, {"token": F.lit("t"), "chunk": F.col("n_words")}, {}, 50, 1).count() > 0


def test_language_id(spark):
    df = awkward(spark).withColumn("score", F.lit("clash"))
    model = language_id.fit(df)
    out = language_id.predict(df, model)
    assert count(out) == count(df) and set(out.columns) == {*df.columns, "lang_pred", "rejected"}
    # Rows that all have one id, or none, are drawn by their texts.
    many = spark.createDataFrame([(None, f"the cat number {i} sat", "en") for i in range(2000)] + [(None, f"die Katze Nummer {i} lag da", "de") for i in range(50)] + [(None, "une phrase", "fr")] * 3000, "doc_id long, text string, lang string")
    assert set(language_id.fit(many, fit_rows=20).langs) == {"de", "en", "fr"}


def test_ties_between_languages_go_to_the_first_in_order(spark):
    rows = [(i, f"same words in both {chr(97 + i % 5)}", lang) for i, lang in enumerate(["xx", "aa", "mm"] * 30)]
    df = spark.createDataFrame([(i % 30, t, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    twice = df.select("doc_id", F.lit("just the same text").alias("text"), "lang")
    got = language_id.predict(twice, language_id.fit(twice)).collect()
    assert {(r["lang_pred"], round(r["score"], 4)) for r in got} == {("aa", 1.0)}


def test_nearest_centroids_by_brute_force(spark, sf_dir):
    """Cosines with the centroids from n-grams counted one by one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs)

    def cosines(text):
        b = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in text.encode())
        n = Counter()
        for order in (1, 2, 3):
            for i in range(len(b) - order + 1):
                n[(((int.from_bytes(b[i : i + order], "big") + (order << 24)) * 2654435761) % (1 << 32)) >> 20] += 1
        v = np.zeros(language_id.DIM)
        for k, c in n.items():
            v[k] = (1 + np.log(c)) * model.idf[k]
        return model.centroids.astype(float) @ (v / np.linalg.norm(v))

    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    seen = 0
    for d in docs.collect():
        if d["text"] and any(c.isalpha() for c in d["text"]):
            c, r = cosines(d["text"]), got[d["doc_id"]]
            seen += 1
            assert abs(r["score"] - min(1, c.max())) < 1e-4
            assert r["lang_pred"] in {x for x, s in zip(model.langs, c, strict=True) if s > c.max() - 1e-4}
    assert seen > 20


def test_token_store(spark, tmp_path):
    df = awkward(spark)
    token_store.write_store(df, str(tmp_path / "s"), WORDS, 2)
    got = token_store.verify_store(spark, str(tmp_path / "s"))
    assert count(got) == count(df)
    at = sorted((r["start"], r["n_tokens"]) for r in got.collect())
    assert [s for s, _ in at] == [0, *np.cumsum([n for _, n in at])[:-1].tolist()]
    ids = {(r["doc_id"], r["start"]): r["ids"] for r in token_store.read_documents(spark, str(tmp_path / "s")).collect()}
    assert all(zlib.crc32(np.array(ids[r["doc_id"], r["start"]], "<u4").tobytes()) == r["ids_crc32"] for r in got.collect())


def test_token_store_of_many_alike_documents(spark, tmp_path, monkeypatch):
    """Recipes of alike documents are dealt over all partitions, and their common chunk is looked up without gathering."""
    monkeypatch.setattr("meridian.llm._io.HOT_ROWS", 20)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("alike")).alias("text"))
    token_store.write_store(df, str(tmp_path / "s"), WORDS, 2)
    got = token_store.verify_store(spark, str(tmp_path / "s")).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(400)) and len({r["ids_crc32"] for r in got}) == 2
    parts = [r["count"] for r in spark.read.parquet(str(tmp_path / "s/recipes")).groupBy("part").count().collect()]
    assert max(parts) < 250


def test_quality_rules(spark):
    df = awkward(spark).withColumn("kept", F.lit("clash"))
    out = quality_rules.with_quality(df)
    assert count(out) == count(df) and dict(out.dtypes)["kept"] == "boolean" and dict(out.dtypes)["n_words"] == "bigint"


def test_graph_index(spark):
    v = [[float(i == j) + 0.01 * i for j in range(4)] for i in range(4)]
    rows = [(i, v[i % 4]) for i in range(200)] + [(7, v[3]), (7, v[3]), (None, v[0]), (300, [None, 1.0, 1.0, 1.0]), (301, [1.0, 2.0]), (302, [3.0, 4.0]), (303, [float("inf")] * 4)]
    df = spark.createDataFrame([(i, x, "e", 5) for i, x in rows], "vec_id long, embedding array<double>, id string, dim int")
    got = graph_index.search(graph_index.build(df), df.filter("vec_id % 50 = 0 or vec_id > 300"), k=5).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert by[0] == [4, 8, 12, 16, 20] and by[50] == [2, 6, 10, 14, 18] and by[301] == [302] and set(by) == {0, 50, 100, 150, 301, 302}


def test_graph_index_of_equal_queries(spark, monkeypatch):
    monkeypatch.setattr("meridian.llm._io.HOT_ROWS", 5)
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") % 10 == 0).cast("double")).alias("embedding"))
    got = graph_index.search(graph_index.build(df), df, k=3)
    assert got.count() == 900 and got.filter("rank = 1 and vec_id > 10").count() == 0


def test_jaccard_join(spark):
    df = awkward(spark)
    out = near_duplicates(df).collect()
    assert Counter(str(r["doc_id"]) for r in out) == count(df)
    assert all(r["component_id"] == r["doc_id"] for r in out if r["doc_id"] is not None) and all(r["component_id"] is None for r in out if r["doc_id"] is None)


def test_jaccard_join_where_one_shingle_is_in_every_prefix(spark, monkeypatch):
    """Hot shingles go through broadcasts and salts; the links are the same as without."""
    stem = [f"c{i}" for i in range(30)]
    docs = [(i, " ".join([*stem, *(f"u{i % 60}x{k}" for k in range(4 + i % 5))])) for i in range(240)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    made = lambda: sorted(map(tuple, near_duplicates(df).collect()))
    want = made()
    for module in ("_io", "jaccard_join"):
        monkeypatch.setattr(f"meridian.llm.{module}.HOT_ROWS", 3)
    assert made() == want
    sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in docs}
    root = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert want == [(i, len(s), root[i]) for i, s in sorted(sets.items())]


def test_jaccard_join_at_any_percent(spark):
    """At 100 percent only equal sets are linked, at 1 nearly all that share a shingle."""
    stem = [f"c{i}" for i in range(12)]
    docs = [(i, " ".join([*stem[: 6 + i % 6], *(f"u{i % 9}x{k}" for k in range(i % 4))])) for i in range(60)]
    sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(max(1, len(w) - 4))} for i, t in docs}
    for percent in (1, 60, 100):
        root = {i: i for i in sets}
        for i in sets:
            for j in range(i):
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    a, b = root[i], root[j]
                    root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
        got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=percent)
        assert sorted(map(tuple, got.collect())) == [(i, len(s), root[i]) for i, s in sorted(sets.items())]


def test_warc(spark):
    df = spark.createDataFrame([(None, None, None, "k"), (1, "http://e", "<p>a", "k"), (1, "http://e", "<p>a", "k")], "page_id long, url string, html string, record string")
    out = warc.derive(warc.responses(df)).collect()
    assert len(out) == 6 and all(r["record"].startswith("WARC/1.1") for r in out)


def test_hostile_pages_take_no_longer(spark):
    """A megabyte of marks that nothing closes: seconds, not hours."""
    unit = ["<title>", "<a ", "<html ", "<!--", "<script>", "<p", "&", "<a href=\"x' ", "</title"]
    pages = spark.createDataFrame([(i, "http://e", (u * (1 << 20))[: 1 << 20]) for i, u in enumerate(unit)], "page_id long, url string, html string").repartition(4)
    began = time.time()
    assert warc.derive(warc.responses(pages)).select(F.sum("content_length")).first()[0] > 1 << 20
    assert time.time() - began < 60


def test_titles_and_attributes(spark):
    rows = ["<TITLE x='y'>One</Title><title>two</title>", "<title>open", "<title no end </title", "<titled>a</title>", "<title></title>", "<a href='1'><a x=y><A HREF=2 href=3><a data-href=4 href=\"5\"", "<html><html lang=de><html lang=fr>"]
    got = spark.createDataFrame(enumerate(rows), "i int, h string")
    got = warc.with_title(got, "h", "t").orderBy("i").select("t", warc.attributes(F.col("h"), "a", "href").alias("a"), warc.attributes(F.col("h"), "html", "lang").alias("l"))
    got = [tuple(r) for r in got.collect()]
    assert [r[0] for r in got] == ["One", "", "", "", "", "", ""] and got[5][1] == ["'1'", "2", '"5"'] and got[6][2] == ["de", "fr"] and not any(r[1] for r in got[:5])


def test_token_counts(spark):
    out = token_counts.with_token_counts(awkward(spark), RANKS)
    assert count(out) == count(awkward(spark)) and dict(out.dtypes)["n_tokens"] == "bigint"


def test_very_long_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = dict(enumerate(unit * (200_000 // len(unit)) + " end" for unit in ("word ", "ü", "a b\n", "x")))
    df = spark.createDataFrame([*((i, t, "en") for i, t in texts.items()), (9, "short text", "en")], "doc_id long, text string, lang string")
    words = {i: len(t.split()) for i, t in texts.items()} | {9: 2}
    bpe = {r["doc_id"]: r for r in encode_decode(df, RANKS, keep_ids=False, keep_text=False).collect()}
    assert all(bpe[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items())
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.with_quality(df).collect()} == words
    assert {r["doc_id"]: r["n_words"] for r in remove_repeats(df).collect()} == words
    assert near_duplicates(df).count() == 5 and language_id.predict(df, language_id.fit(df)).count() == 5
    assert {r["n_tokens"] > 0 for r in token_counts.with_token_counts(df, RANKS).collect()} == {True}
    token_store.write_store(df, str(tmp_path / "s"), WORDS, 2)
    got = {r["doc_id"]: r["n_tokens"] for r in token_store.verify_store(spark, str(tmp_path / "s")).collect()}
    tok = Tokenizer.from_file(WORDS)
    assert all(got[i] == len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items())
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("http://e").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    assert warc.derive(warc.responses(pages)).filter("warc_type = 'conversion'").count() == 5
