import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = "the of and to a in is that der die das und ist le la les des et el los y que café naïve Ärger x1 foo's a,b".split()


def texts() -> list[str | None]:
    r = random.Random(5)
    line = lambda n: " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ",", "1"]) for _ in range(n))
    passage, base = line(60), line(120)
    out = [None, "", " \t\n ", "one", "a b c d", "I'm don't we'LL  tabs\there\r\nand\x0bvt  ", "😀 emoji ''' --- 123abc ٣٤ éàü nb sp", "=" * 300, "ab " * 400, "line a\nline a\nline b\n\nline a"]
    out += [line(r.randint(1, 200)) for _ in range(25)]
    out += [line(20) + " " + passage + " " + line(15) for _ in range(4)] + [passage + " " + passage]
    out += [base, base, base + " tail", base.replace("the", "this", 2), base.upper()]
    out += [line(3000)]
    return out


@pytest.fixture(scope="session")
def sf_dir(tmp_path_factory):
    """Small tables with nulls, empty and long texts, copies, shared passages, repeated rows and clashing column names."""
    d = tmp_path_factory.mktemp("sf")
    found = texts()
    langs = ["en", "de", None, "fr"]
    docs = {"doc_id": [*range(len(found))], "text": found, "lang": [langs[i % 4] for i in range(len(found))], "source": [None if i % 11 == 0 else f"src{i % 3}" for i in range(len(found))], "n_chars": [None if x is None else len(x) for x in found]}
    pq.write_table(pa.table(docs, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([*range(len(found)), None, 3, 4, 999], pa.int64()), "quality": pa.array([1] * (len(found) + 4), pa.int32()), "toxic": pa.array([*(int(i % 5 == 0) if i % 7 else None for i in range(len(found))), 1, 0, 2, 1], pa.int32())}), d / "labels.parquet")
    r = random.Random(3)
    vectors = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [1.0] * 8, [1.0] * 8, [2.0] * 8, []] + [[r.gauss(0, 1) for _ in range(8)] for _ in range(300)]
    vectors += [vectors[9]] * 40
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())}), d / "embeddings.parquet")
    pages = ["<HTML class=\"a\" lang = de><title>&eacute;&#233;&#xE9;&Eacute;&unknown;&amp;lt;&#0;&#x1F600;&#1114112;</title><a class='x'href='/s?a=1&amp;b=2'>s</a><a data-href=\"no\" HREF = /plain>p</a><a href=\"q'q\">&hearts; &nosuch; & &&lt; &#38; &#xZZ;</a>", None, "", "plain", "<p>a&amp;lt;b</p><script>x<y", "<html lang='x'><title> T\n t </title><!-- c --><a href=\"/u\">l</a><br>z &copy; <b>q</b>", "<p>unclosed <a href=\"/v\""]
    pq.write_table(pa.table({"page_id": pa.array(range(len(pages)), pa.int64()), "url": [None] + [f"http://e/{i}" for i in range(1, len(pages))], "html": pa.array(pages, pa.string())}), d / "pages.parquet")
    return str(d)
