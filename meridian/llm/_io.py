"""Table access and shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else one in the warehouse; a local one only in a local session without either, as in tests."""
    if where := spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.meridian.scratch", None):
        return where
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        where = tempfile.mkdtemp(prefix="meridian-")
    else:
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/meridian-scratch"
    spark.conf.set("spark.meridian.scratch", where)
    return where


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no more than a re-read."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes the files of a written table that no later plan reads."""
    spark = table.sparkSession
    for folder in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def chunked(docs: DataFrame, id_col: str, text_col: str, by: list[str | Column], n: int | None = None, rest: bool = False) -> DataFrame:
    """(chunk, id, text, tie): documents dealt evenly by a hash of the columns by (of id and text). tie: a hash of the text. rest: all other columns too, as a struct."""
    p = partitions(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*others).alias("rest")] if rest and others else []))
    return rows.select(chunk_of(n or 2 * p, *by).alias("chunk"), "*", F.xxhash64("text").alias("tie")).repartition(p, "chunk")


def chunk_of(n: int, *by: str | Column) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


HOT_ROWS, HOT_KEYS = 512, 100_000


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame:
    """The keys in counts (key, rows) with more than HOT_ROWS rows and more than one in HOT_KEYS of all; so there are fewer than HOT_KEYS of them."""
    return counts.filter(F.col("rows") > max(HOT_ROWS, -(-total // HOT_KEYS))).select(key)


def looked_up(rows: DataFrame, facts: DataFrame, key: str, hot: DataFrame, hot_facts: DataFrame | None = None) -> DataFrame:
    """rows joined to facts, which has a key once. Rows of hot keys (fewer than HOT_KEYS) meet a broadcast of their facts where they are; no task gathers a hot key's rows."""
    cold = rows.join(F.broadcast(hot), key, "left_anti").join(facts, key)
    found = facts.join(F.broadcast(hot), key) if hot_facts is None else hot_facts
    return cold.unionByName(rows.join(F.broadcast(found), key))
