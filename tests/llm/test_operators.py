"""Each operator's query against a brute-force version, or against its SQL, over small awkward tables."""

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meridian.llm import graph_index, language_id, mixing, queries, quality_rules, token_counts, token_store, warc
from meridian.llm._graph import components
from meridian.llm._pretoken import pretokens
from meridian.llm.byte_bpe import encode_decode
from meridian.llm.jaccard_join import near_duplicates
from meridian.llm.substring_dedup import remove_repeats

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def documents(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    plain = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
    assert plain(got) == plain(want)


def test_byte_bpe(spark, sf_dir):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(queries.op1_byte_bpe(spark, sf_dir))
    docs = documents(sf_dir)
    assert len(got) == len(docs)
    for d in docs:
        ids = enc.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())


def test_byte_bpe_keeps_ids_texts_and_other_columns(spark):
    df = spark.createDataFrame([(1, "hi there", "x"), (2, None, None)], "doc_id long, text string, lang string")
    got = encode_decode(df, RANKS).orderBy("doc_id").collect()
    assert got[0]["decoded"] == "hi there" and len(got[0]["ids"]) == got[0]["n_tokens"] and got[0]["lang"] == "x"
    assert got[1]["ids"] == [] and got[1]["decoded"] == ""


def test_pretokens_match_the_pattern():
    import regex

    alphabet = [" ", "  ", "\n", "\t", "a", "é", "1", "٣", "'", "'s", "'ll", "'re", "-", " ", "😀", "　"]
    r = np.random.default_rng(1)
    for _ in range(400):
        text = "".join(r.choice(alphabet, r.integers(0, 14)))
        b = text.encode()
        s, e, _ = pretokens(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        assert [b[i:j].decode() for i, j in zip(s, e, strict=True)] == regex.findall(public_tokenizers.PATTERN, text)


def brute_repeats(docs, width=20):
    first, out = {}, {}
    order = sorted(docs, key=lambda d: d["doc_id"])
    words = {d["doc_id"]: SPLIT.findall(d["text"] or "") for d in order}
    for d in order:
        w = words[d["doc_id"]]
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first.setdefault(tuple(w[i : i + width]), (d["doc_id"], i)) != (d["doc_id"], i):
                gone[i : i + width] = [True] * width
        out[d["doc_id"]] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_substring_dedup(spark, sf_dir):
    got = rows(queries.op2_substring_dedup(spark, sf_dir))
    assert {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in got.items()} == brute_repeats(documents(sf_dir))


def test_substring_dedup_of_repeated_rows_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "a", 5), (1, text, "b", 6), (None, "x", "c", 7)], "doc_id long, text string, rest string, n_words int")
    got = remove_repeats(df, with_text=True).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 0, 30] and sorted(r["rest"] for r in got) == ["a", "b", "c"]
    assert remove_repeats(df.limit(0)).count() == 0


def test_source_mixing(spark, sf_dir):
    against_sql(spark, sf_dir, "op3_source_mixing")


def test_shortages_go_to_siblings_before_ancestors(spark):
    sizes = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "domain string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(sizes, ["domain", "source"], {}, 40, 1).collect()}
    assert got == {"x": 10, "y": 392, "z": 402}
    got = {r["source"]: r["budget"] for r in mixing.budgets(sizes, ["domain", "source"], {"domain": {"a": 3}}, 90, 1).collect()}
    assert got == {"x": 10, "y": 1000, "z": 799}


def test_shortages_below_a_weight_of_zero_go_on(spark):
    """What a leaf of weight 0 could hold doesn't count, so its parent asks for no more than its other leaves have."""
    sizes = spark.createDataFrame([("a", "x", 100), ("a", "off", 900), ("b", "z", 1000), ("c", "z", 0)], "domain string, source string, tokens long")
    got = {(r["domain"], r["source"]): r["budget"] for r in mixing.budgets(sizes, ["domain", "source"], {"source": {"off": 0}}, 40, 1).collect() if r["budget"]}
    assert got == {("a", "x"): 100, ("b", "z"): 700}
    assert not any(r["budget"] for r in mixing.budgets(sizes, ["domain", "source"], {"source": {"off": 0, "x": 0, "z": 0}}, 40, 1).collect())


def brute_budgets(tokens, weights, percent, epochs):
    """Budgets of leaves (tuples of names) by water filling from the root, in whole numbers."""
    weight = lambda depth, name: weights[depth].get(name, 1)
    live = {k: n for k, n in tokens.items() if n and all(weight(i, x) for i, x in enumerate(k))}
    out = {}

    def share(prefix, budget):
        depth = len(prefix)
        if depth == len(weights):
            out[prefix] = budget
            return
        cap, w = {}, {}
        for k, n in live.items():
            if k[:depth] == prefix:
                cap[k[depth]] = cap.get(k[depth], 0) + n * epochs
                w[k[depth]] = weight(depth, k[depth])
        left = budget
        while full := [x for x in cap if cap[x] * sum(w[y] for y in cap) <= w[x] * left]:
            x = min(full, key=lambda y: (cap[y] / w[y], y))
            share((*prefix, x), cap[x])
            left -= cap.pop(x)
        total = sum(w[x] for x in cap)
        for x in cap:
            share((*prefix, x), w[x] * left // total)

    share((), min(sum(tokens.values()) * percent // 100, sum(live.values()) * epochs))
    return out


def brute_mixture(docs, weights, percent, epochs, seed):
    """(doc_id, epoch, words used) of all chosen rows."""
    leaves = {}
    for d in docs:
        m = re.search("([0-9]+)$", d["source"] or "")
        leaves.setdefault((f"d{int(m[1]) % 4}" if m else "", d["lang"] or "", d["source"] or ""), []).append((d["doc_id"], len(SPLIT.findall(d["text"] or "")), hashlib.md5((d["text"] or "").encode()).hexdigest()))
    plan = brute_budgets({k: sum(n for _, n, _ in v) for k, v in leaves.items()}, weights, percent, epochs)
    out = []
    for leaf, rows in leaves.items():
        if leaf in plan:
            whole, rest = divmod(plan[leaf], sum(n for _, n, _ in rows))
            out += [(i, e, n) for i, n, _ in rows for e in range(whole)]
            for i, n, _ in sorted(rows, key=lambda r: hashlib.md5("|".join(map(str, [seed, whole, *([] if r[0] is None else [r[0]]), r[2]])).encode()).hexdigest()):
                if rest > 0:
                    out.append((i, whole, min(n, rest)))
                rest -= n
    return out


def test_source_mixing_by_brute_force(spark, sf_dir):
    docs = documents(sf_dir)
    levels = {"domain": mixing.domain(), "lang": F.col("lang"), "source": F.col("source")}
    for weights, percent, epochs in ((mixing.WEIGHTS, 60, 3), ({"lang": {"en": 0, "de": 3}, "source": {"src1": 0}}, 95, 2)):
        got = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), levels, weights, percent, epochs, 17).collect()
        want = brute_mixture(docs, [weights.get(x, {}) for x in levels], percent, epochs, 17)
        assert sorted((r["doc_id"], r["epoch"], r["n_used"]) for r in got) == sorted(want)


@pytest.mark.parametrize("texts", [lambda i: f"w{i} " * 10, lambda i: "same word " * 5, lambda i: f"w{i % 3} " * 10])
@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: i])
def test_mixing_keeps_to_the_budget_where_ids_repeat(spark, texts, ids, monkeypatch):
    """Rows without an id, with one id, and rows alike in all: the words given out are those of the budget."""
    rows = [{"doc_id": ids(i), "text": texts(i), "lang": "en", "source": f"src{i % 2}"} for i in range(100)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, lang string, source string").repartition(3)
    for percent in (10, 33, 107):
        for most in (mixing.MOST_LEAVES, 0):
            monkeypatch.setattr(mixing, "MOST_LEAVES", most)
            got = mixing.mix(df, {"domain": mixing.domain(), "lang": F.col("lang"), "source": F.col("source")}, {}, percent, 3, 17).collect()
            assert sum(r["n_used"] for r in got) == 10 * percent
            key = lambda x: tuple(map(str, x))
            assert sorted(((r["doc_id"], r["epoch"], r["n_used"]) for r in got), key=key) == sorted(brute_mixture(rows, [{}, {}, {}], percent, 3, 17), key=key)


def test_mixing_with_a_plan_that_is_not_broadcast(spark, sf_dir, monkeypatch):
    levels = {"domain": mixing.domain(), "lang": F.col("lang"), "source": F.col("source")}
    made = lambda: sorted(map(str, mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), levels, mixing.WEIGHTS).collect()))
    want = made()
    monkeypatch.setattr(mixing, "MOST_LEAVES", 0)
    monkeypatch.setattr("meridian.llm._io.HOT_ROWS", 3)
    assert made() == want


def test_mixing_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, epoch string")
    assert mixing.mix(df, {"source": F.col("source")}, {}).count() == 0


def test_language_id(spark):
    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op4_language_id(spark, d).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_language_id_of_awkward_texts(spark, sf_dir):
    got = rows(queries.op4_language_id(spark, sf_dir))
    for i in (0, 1, 2, 7):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
    assert {r["lang_pred"] for r in got.values()} <= {"en", "de", "fr", "und"}
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.predict(none, language_id.fit(none)).first()["lang_pred"] == "und"


def test_language_rejection(spark):
    model = language_id.fit(spark.createDataFrame([(i, "the cat and the dog sat on the mat with a hat " * (1 + i % 3), "en") for i in range(20)], "doc_id long, text string, lang string"))
    got = language_id.predict(spark.createDataFrame([(1, "the cat and the dog sat on the mat"), (2, "zzqx kkwv jjpq")], "doc_id long, text string"), model, reject=True)
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()}[2] == "und"


def test_token_store(spark, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = rows(queries.op5_token_store(spark, sf_dir))
    start = 0
    for d in sorted(documents(sf_dir), key=lambda d: d["doc_id"]):
        ids = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_store_gives_ids_back_and_finds_damage(spark, sf_dir, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(3, "a b"), (1, None), (2, "one two three")], "doc_id long, text string")
    token_store.write_store(df, str(tmp_path / "s"), path, 2)
    got = {r["doc_id"]: r["ids"] for r in token_store.read_documents(spark, str(tmp_path / "s")).collect()}
    assert got[1] == [2] and got[2] == [*Tokenizer.from_file(path).encode("one two three", add_special_tokens=False).ids, 2]


def test_token_store_without_a_part_is_an_error(spark, tmp_path):
    """Whatever is missing or changed in a table of the store, both readers raise."""
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(k, f"some words of text {k} and {k * k} more") for k in range(8)] + [(None, None), (None, ""), (2, None)], "doc_id long, text string")
    whole = str(tmp_path / "s")
    token_store.write_store(df, whole, path, 2)
    assert token_store.verify_store(spark, whole).count() == token_store.read_documents(spark, whole).count() == 11
    read = {t: spark.read.parquet(f"{whole}/{t}") for t in ("objects", "recipes", "manifest", "head")}
    none = read["objects"].filter("kind = 'chunk'").orderBy("digest").first()["digest"]
    part = read["recipes"].filter("doc_id = 3").first()["part"]
    broken = {
        "recipe": {"recipes": read["recipes"].filter("not doc_id <=> 3")},
        "part": {"recipes": read["recipes"].filter(F.col("part") != part), "manifest": read["manifest"].filter(F.col("part") != part)},
        "place": {"recipes": read["recipes"].withColumn("start", F.col("start") + 1)},
        "root": {"recipes": read["recipes"].withColumn("root", F.lit(b"x"))},
        "chunk": {"objects": read["objects"].filter(~F.col("digest").eqNullSafe(F.lit(bytes(none))))},
        "data": {"objects": read["objects"].withColumn("data", F.when(F.col("data").isNotNull(), F.expr("concat(data, X'0000')")))},
        "manifest": {"manifest": read["manifest"].filter(F.col("part") != part)},
        "head": {"head": read["head"].withColumn("tokens", F.lit(1).cast("long"))},
    }
    for name, changed in broken.items():
        for t, table in (read | changed).items():
            (table.write.partitionBy("kind") if t == "objects" else table.write).parquet(f"{tmp_path}/{name}/{t}")
        for reader in (token_store.verify_store, token_store.read_documents):
            with pytest.raises(Exception, match="does not match|do not match|damaged"):
                reader(spark, f"{tmp_path}/{name}").collect()


def test_quality_rules(spark, sf_dir):
    against_sql(spark, sf_dir, "op6_quality_rules")


def test_quality_counts_by_brute_force(spark, sf_dir):
    got = rows(queries.op6_quality_rules(spark, sf_dir))
    for d in documents(sf_dir):
        text = d["text"] or ""
        w = SPLIT.findall(text)
        seen, covered = {}, set()
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                covered.update(i + k for i in at for k in range(5))
        lines = [x for x in text.split("\n") if SPLIT.search(x)]
        r = got[d["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["kept"] and r["base_failed"])


def test_quality_verdict_survives_a_filter(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat and then it went away home"), (2, "x")], "doc_id long, text string")
    assert [r["doc_id"] for r in quality_rules.with_quality(df).filter("kept").select("doc_id").collect()] == [1]


def exact(vectors, queries, k = 5, id_col = "vec_id", vector_col = "embedding"):
    """The same rows by brute force over small inputs, to measure recall against."""
    a, b = graph_index._usable(queries, id_col, vector_col), graph_index._usable(vectors, id_col, vector_col)
    dot = F.aggregate(F.zip_with("a.vector", "b.vector", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    pairs = a.alias("a").join(F.broadcast(b.alias("b")), F.expr("a.dim = b.dim and a.id <> b.id"))
    scored = pairs.select(F.col("a.id").alias("query_id"), F.col("b.id").alias("vec_id"), (dot / (length("a.vector") * length("b.vector"))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def test_graph_index(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = queries.op7_graph_index(spark, sf_dir).collect()
    want = exact(vectors, vectors.filter("vec_id % 50 = 0"), 5).collect()
    key = lambda r: (r["query_id"], r["vec_id"])
    assert len(got) == len(want) and len({*map(key, got)} & {*map(key, want)}) >= 0.9 * len(want)
    score = {key(r): r["score"] for r in want}
    assert all(abs(score[key(r)] - r["score"]) < 1e-12 for r in got if key(r) in score)


def test_graph_index_recall_over_a_larger_shard(spark):
    d = "/root/testdata/sf0.1"
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    got = {(r["query_id"], r["vec_id"]) for r in queries.op7_graph_index(spark, d).collect()}
    want = {(r["query_id"], r["vec_id"]) for r in exact(vectors, vectors.filter("vec_id % 50 = 0"), 5).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_graph_index_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert graph_index.search(graph_index.build(df), df).count() == 0


def brute_links(docs):
    sets = {}
    for d in docs:
        w = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or ""))
        sets[d["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_jaccard_join(spark, sf_dir):
    got = rows(queries.op8_ngram_jaccard_join(spark, sf_dir))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == brute_links(documents(sf_dir))


def test_jaccard_join_of_chains(spark):
    """Documents that drift word by word: linked through others, not directly; anchors alone would miss links."""
    words = [f"w{i}" for i in range(400)]
    docs = [{"doc_id": 7 * (k * 13 % 40) + 1, "text": " ".join(words[4 * k : 4 * k + 60])} for k in range(40)]
    docs += [{"doc_id": 1000 + k, "text": " ".join(words[:100] + [f"z{k}"])} for k in range(30)]
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")
    got = rows(near_duplicates(df))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == brute_links(docs)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 102), (101, 102)], "u long, v long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert all(got[i] == 1 for i in range(2, 61)) and got[102] == 100 and got[101] == 100


def test_warc(spark, sf_dir):
    against_sql(spark, sf_dir, "op9_warc_derivatives")


def test_warc_records_read_back(spark, sf_dir):
    out = warc.derive(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))).withColumnRenamed("block", "own")
    for r in warc.parse(out).collect():
        assert r["block"] == r["own"] and r["headers"]["warc-refers-to"] == r["refers_to"] and int(r["headers"]["content-length"]) == len(r["own"].encode())
        assert r["headers"]["warc-block-digest"] == "sha256:" + hashlib.sha256(r["own"].encode()).hexdigest()


def test_text_of_html(spark):
    cases = {"<p>a</p><p>b</p>": "a\nb", "x&#65;&#x1F600;&#0;&#zz;": "xA😀�&#zz;", "a<script>1</script>b": "a b", "<!-- <p> -->t": "t", "1 < 2": "1 < 2", "&amp;lt;": "&lt;", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "html string").withColumn("t", warc.text_of(F.col("html")))
    assert {r["html"]: r["t"] for r in df.collect()} == cases


def test_token_counts(spark, sf_dir):
    import regex

    model = token_counts.Unigram(RANKS)

    def brute(word):
        best = [0] + [1 << 62] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(max(0, e - model.lengths[-1]), e):
                if (c := model.cost.get(word[s:e])) is not None:
                    best[e] = min(best[e], best[s] + c)
        return best[-1] & 0xFFFFFF

    got = rows(queries.op10_token_counts(spark, sf_dir))
    for d in documents(sf_dir):
        words = regex.findall(public_tokenizers.PATTERN, d["text"] or "")
        assert (got[d["doc_id"]]["n_pretokens"], got[d["doc_id"]]["n_tokens"]) == (len(words), sum(brute(w.encode()) for w in words))


def test_token_counts_of_a_very_long_pretoken():
    model = token_counts.Unigram(RANKS)
    byte = 0xF5  # in no piece but its own
    assert sum(byte in piece for piece in model.cost) == 1
    assert model.measure([bytes([byte]) * 3_000_000, b"a"]).tolist() == [3_000_000, 1]
    rng = np.random.default_rng(4)
    stem = rng.choice(np.frombuffer(b"aetnos", np.uint8), 100)
    words = [np.r_[stem[:k], rng.choice(np.frombuffer(b"aetnos", np.uint8), n)] for k, n in ((0, 65), (90, 200), (100, 1), (100, 700), (100, 0), (3, 20))]
    counted = model.measure([w.tobytes() for w in words]).tolist()
    for word, count in zip(words, counted, strict=True):  # as by the sums of 64 bits, where these suffice
        n = len(word)
        best = [0] + [1 << 62] * n
        for e in range(1, n + 1):
            best[e] = min(best[s] + c for s in range(max(0, e - model.lengths[-1]), e) if (c := model.cost.get(word[s:e].tobytes())) is not None)
        assert count == best[n] & 0xFFFFFF


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P
    import tiktoken

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in queries.op6_quality_rules(spark, sf_dir).collect() if r["kept"]}
    one = P.quality(spark, docs, sf_dir)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == kept
    two = P.near_duplicate(spark, one, sf_dir)
    groups = brute_links([r.asDict() for r in one.collect()])
    assert {r["doc_id"] for r in two.collect()} == {g for _, g in groups.values()}
    three = P.repeated_passages(spark, two, sf_dir)
    want = {k: v for k, v in brute_repeats([r.asDict() for r in two.collect()]).items() if v[0] > v[1] or not v[0]}
    assert three.columns == docs.columns and {r["doc_id"] for r in three.collect()} == set(want)
    four = P.mixture(spark, three, sf_dir)
    before = {r["doc_id"]: r.asDict() for r in three.collect()}
    used = brute_mixture(before.values(), [mixing.WEIGHTS.get(x, {}) for x in ("domain", "lang", "source")], mixing.PERCENT, mixing.MAX_EPOCHS, mixing.SEED)
    assert four.columns == [*docs.columns, "mix_epoch"] and sorted((r["doc_id"], SPLIT.findall(r["text"] or "")) for r in four.collect()) == sorted((i, SPLIT.findall(before[i]["text"] or "")[:n]) for i, _, n in used)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
    digest = lambda text: hashlib.sha256(np.array(enc.encode_ordinary(text or ""), "<u4").tobytes()).hexdigest()
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in P.run(spark, sf_dir).collect()) == sorted((r["doc_id"], digest(r["text"])) for r in four.collect())


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Columns named like the operators' own, rows without an id, repeated rows, and no rows at all."""
    import corpus_pipeline as P

    text = lambda i: " ".join(f"{w}{i}" for w in "the of and to in words that are here for this line so it stays".split()) + " the of and to a in"
    rows = [(i if i % 4 else None, text(i // 2), "en", f"src{i % 3}", 100, f"n{i}", "e", "k", f"id{i}", "input") for i in range(40)] + [(90, None, None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, epoch string, kept string, id string, input_1 string"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    given = {(r[0], r[5], r[8]): r for r in rows}
    at = docs
    for _, stage in P.STAGES[:-1]:
        at = stage(spark, at, "")
        assert at.columns[: len(docs.columns)] == docs.columns and [at.schema[c].dataType for c in docs.columns] == [f.dataType for f in docs.schema]
        for r in at.collect():
            old = given[r["doc_id"], r["n_words"], r["id"]]
            assert (r["lang"], r["source"], r["epoch"], r["kept"], r["input_1"]) == (old[2], old[3], old[6], old[7], old[9])
    assert at.count() > 10 and {r["mix_epoch"] for r in at.collect()} >= {0} and any(r["doc_id"] is None for r in at.collect())
    assert P.run(spark, f"{tmp_path}/a").count() == at.count() and P.run(spark, f"{tmp_path}/b").count() == 0


def test_pipeline_keeps_to_the_budgets_of_leaves(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaves = ["domain", "lang", "source"]
    words = F.coalesce(F.regexp_count("text", F.lit(SPLIT.pattern)), F.lit(0)).cast("long")
    held = lambda df: df.select(*(F.coalesce(x, F.lit("")).alias(c) for c, x in zip(leaves, (mixing.domain(), F.col("lang"), F.col("source")))), words.alias("n")).groupBy(*leaves).agg(F.sum("n").alias("tokens"))
    want = {tuple(r[c] for c in leaves): r["budget"] for r in mixing.budgets(held(docs), leaves, mixing.WEIGHTS, mixing.PERCENT, mixing.MAX_EPOCHS).collect() if r["budget"]}
    out = P.mixture(spark, docs, sf_dir)
    assert {tuple(r[c] for c in leaves): r["tokens"] for r in held(out).collect() if r["tokens"]} == want
    before = {d["doc_id"]: d for d in documents(sf_dir)}
    rows = [r.asDict() for r in out.collect()]
    cut = [r for r in rows if r["text"] != before[r["doc_id"]]["text"]]
    assert cut and all(before[r["doc_id"]]["text"].startswith(r["text"]) and r["text"] and not r["text"][-1].isspace() and r["n_chars"] == len(r["text"]) for r in cut)
    assert all(r["n_chars"] == before[r["doc_id"]]["n_chars"] for r in rows if r not in cut)


def test_first_words(spark):
    cases = [(" \t a  b\n c ", 1, " \t a"), (" \t a  b\n c ", 2, " \t a  b"), ("é\u00a0x 😀\x0by", 1, "é\u00a0x"), ("é\u00a0x 😀\x0by", 2, "é\u00a0x 😀"), ("w " * 50_000, 49_999, ("w " * 49_999)[:-1])]
    df = spark.createDataFrame([(t, n, w) for t, n, w in cases], "text string, n long, want string")
    assert [r["got"] for r in df.select(mixing.first_words(F.col("text"), F.col("n")).alias("got")).collect()] == [w for _, _, w in cases]


def test_empty_tables(spark, tmp_path):
    for t, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("pages", "page_id long, url string, html string"), ("embeddings", "vec_id long, embedding array<float>, label int"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, f in queries.QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name
