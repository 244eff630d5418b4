"""The opN_ queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import divergence, graph_index, language_id, mixing, quality_rules, token_counts, token_store, toxicity, warc, whitening
from meridian.llm._io import read, scratch_path
from meridian.llm.byte_bpe import encode_decode
from meridian.llm.jaccard_join import near_duplicates
from meridian.llm.substring_dedup import remove_repeats


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=False, keep_text=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, min_words=20).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    levels = {"domain": mixing.domain(), "lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mix(docs, levels, mixing.WEIGHTS, mixing.PERCENT, mixing.MAX_EPOCHS, mixing.SEED)
    return out.select("doc_id", "domain", *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), "epoch", "n_tokens", "n_used")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    out = language_id.predict(docs.select("doc_id", "text", language_id.held_out().alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-store")
    token_store.write_store(read(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.verify_store(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.with_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_graph_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = graph_index.build(vectors)
    return graph_index.search(index, vectors.filter("vec_id % 50 = 0"), k=5)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), width=5, percent=75)


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.derive(warc.responses(read(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return out.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", "source_digest", "block", "block_digest", "content_length", F.sha2("record", 256).alias("record_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).select("doc_id", "n_tokens", "n_pretokens")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.learned_from(read(spark, sf_dir, "labels").select("doc_id", "toxic")))
    out = toxicity.with_toxicity(docs.withColumn("held_out", toxicity.held_out()), model)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "n_passages", "best")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whitened(vectors, whitening.fit(vectors), components=32)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_substring_dedup, op3_source_mixing, op4_language_id, op5_token_store, op6_quality_rules, op7_graph_index, op8_ngram_jaccard_join, op9_warc_derivatives, op10_token_counts, op11_toxicity, op12_embedding_whitening, op13_source_divergence)}
ORACLE_SQL: dict[str, str] = {"op3_source_mixing": mixing.SQL, "op6_quality_rules": quality_rules.SQL, "op9_warc_derivatives": warc.SQL, "op13_source_divergence": divergence.SQL}
