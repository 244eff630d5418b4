"""A training corpus from documents, stage by stage: quality rules, near duplicates, repeated passages, mixing, token ids.

Cases, in all stages: other columns of the input pass unchanged, also those named like an operator's own (the operators get
what they don't read under numbered names); null texts count as empty; an empty table gives an empty result; rows that are
repeated or have no id are rows like others, but that near duplicates know a row by its id: rows that share an id share their fate,
and rows without one stay. Mixing adds ``mix_epoch``, which tells apart the rows of a document that it repeats.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import mixing, quality_rules
from meridian.llm._io import read, written
from meridian.llm.byte_bpe import encode_decode
from meridian.llm.jaccard_join import near_duplicates
from meridian.llm.substring_dedup import remove_repeats

EPOCH = "mix_epoch"


def _beside(docs: DataFrame, *used: str) -> DataFrame:
    """What an operator reads, and the other columns under numbered names, which are no operator's."""
    return docs.select(*used, *(F.col(f"`{c}`").alias(f"input_{k}") for k, c in enumerate(docs.columns) if c not in used))


def _rows(out: DataFrame, docs: DataFrame, *used: str, cut=None, text=None) -> DataFrame:
    """docs' columns again, of the rows that are left; where cut holds, with another text and its length."""
    columns = docs.columns
    rows = {c: F.col(c if c in used else f"input_{k}") for k, c in enumerate(columns)}
    if cut is not None:
        rows["text"] = F.when(cut, text).otherwise(rows["text"])
        if "n_chars" in rows:
            rows["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(rows["n_chars"])
    return out.select(*(x.alias(c) for c, x in rows.items()), *([F.col("epoch").alias(EPOCH)] if EPOCH not in columns and "epoch" in out.columns else []))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go."""
    return _rows(quality_rules.with_quality(_beside(docs, "text")).filter("kept"), docs, "text")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; a document without an id stays too."""
    gone = near_duplicates(docs.select("doc_id", "text"), width=5, percent=75).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier go; a document of which nothing is left goes; the others keep their text as it was."""
    out = remove_repeats(_beside(docs, "doc_id", "text"), min_words=20, with_text=True).filter("n_removed < n_words or n_words = 0")
    return _rows(out, docs, "doc_id", "text", cut=F.col("n_removed") > 0, text=F.col("kept_text"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights; a row for each epoch. The document at which a leaf's budget ends is cut there."""
    levels = {"domain": mixing.domain(), "lang": F.col("lang"), "source": F.col("source")}
    used = ("doc_id", "text", "lang", "source")
    out = mixing.mix(_beside(docs, *used), levels, mixing.WEIGHTS, mixing.PERCENT, mixing.MAX_EPOCHS, mixing.SEED)
    return _rows(out, docs, *used, cut=F.col("n_used") < F.col("n_tokens"), text=mixing.first_words(F.col("text"), F.col("n_used")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digest and that of the decoded bytes."""
    rows = docs.select("doc_id", "lang", "source", *([EPOCH] if EPOCH in docs.columns else []), "text")
    return encode_decode(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_text=False)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicate), ("substring dedup", repeated_passages), ("source mixing", mixture), ("byte-level BPE", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
