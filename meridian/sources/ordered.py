"""Source order: which row of which file came first.

An ordinal is (file, row in the file, item in an array of the row). It comes from the scan itself, so it is the same however the file
is split, and it stays with its row through shuffles; comparing ordinals compares places in the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDINAL = "ordinal"


def arranged(rows: DataFrame, at: str, n: int, part: str, *order: Column | str, size: int = 500_000) -> DataFrame:
    """n rows written to Parquet files in at, a folder for each part, and read with their ordinals: within a part, files and their rows follow the order.

    Ranges of part and order are dealt over tasks, about size rows each, so that a part may be larger than a task; files bear the numbers
    of their ranges.
    """
    ranges = rows.repartitionByRange(max(1, -(-n // size)), part, *order)
    ranges.sortWithinPartitions(part, *order).write.partitionBy(part).parquet(at)
    return stamped(rows.sparkSession.read.parquet(at))


def stamped(scan: DataFrame) -> DataFrame:
    """The rows of Parquet files with their ordinals; scan has to be as read, before any other operation."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.lit(0).cast("long").alias("item"))
    return scan.select("*", at.alias(ORDINAL))


def items(rows: DataFrame, array: str, into: str) -> DataFrame:
    """A row for each item of an array column, in place of it; null and empty arrays give none."""
    others = [c for c in rows.columns if c not in (array, ORDINAL)]
    out = rows.select(*others, ORDINAL, F.posexplode(array).alias("__item", into))
    return out.select(*others, into, F.struct(F.col(f"{ORDINAL}.file"), F.col(f"{ORDINAL}.row"), F.col("__item").cast("long").alias("item")).alias(ORDINAL))


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of each key that was inserted last; an aggregate, so a key's rows are never gathered."""
    return _picked(rows, F.max, keys)


def earliest(rows: DataFrame, *keys: str) -> DataFrame:
    return _picked(rows, F.min, keys)


def _picked(rows: DataFrame, pick, keys: tuple[str, ...]) -> DataFrame:
    others = [c for c in rows.columns if c not in (*keys, ORDINAL)]
    return rows.groupBy(*keys).agg(pick(F.struct(ORDINAL, *others)).alias("__row")).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in (*others, ORDINAL)))


def first(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows in source order: a sort of n rows in each task, and of theirs."""
    return rows.orderBy(ORDINAL).limit(n)


def numbered(rows: DataFrame, name: str = "number") -> DataFrame:
    """All rows of stamped files with their number from 1 in source order: a file's rows follow those of the files before it.

    Files are counted, so only a row for each file meets in one task.
    """
    sizes = rows.groupBy(F.col(f"{ORDINAL}.file").alias("__file")).agg((F.max(f"{ORDINAL}.row") + 1).alias("__rows"))
    before = F.sum("__rows").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__file", F.coalesce(before, F.lit(0)).alias("__before"))
    return rows.withColumn("__file", F.col(f"{ORDINAL}.file")).join(offsets, "__file").withColumn(name, F.col("__before") + F.col(f"{ORDINAL}.row") + 1).drop("__file", "__before")
