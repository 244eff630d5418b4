"""Changes of tables that are kept in files (SNK1, SNK2, SNK5 to SNK8).

A table is a folder of Parquet partitions: rows are dealt to buckets by a hash of the key. A change rewrites the buckets that it
touches, and has a name of its own. It is prepared in a folder of that name, then marked as prepared, then its buckets replace the
table's (dynamic partition overwrite), then it is marked as done. Running a change again is safe at any point: a done one does nothing,
a prepared one only replaces the buckets again, with the same rows, and what was left of an unprepared one is overwritten.
Changes of one table come one after the other; marks are files that are never overwritten, so of two writers of one change one fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators import dml

BUCKET = "bucket"
DATA, CHANGES, SCHEMA = "data", "changes", "schema"


class Table:
    """A table at a path: its key columns and number of buckets are fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _marked(self, change: str, mark: str) -> bool:
        return self._fs.exists(self._at(CHANGES, change, mark))

    def _mark(self, change: str, mark: str) -> None:
        self._fs.create(self._at(CHANGES, change, mark), False).close()

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> Table:
        rows.limit(0).write.parquet(f"{self.path}/{SCHEMA}")
        rows.withColumn(BUCKET, self.bucket()).repartition(self.buckets, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{DATA}")
        return self

    def _rows(self, *at: str) -> DataFrame:
        """The rows of a folder with their buckets; a table without rows still has its columns."""
        schema = self.spark.read.parquet(f"{self.path}/{SCHEMA}").schema.add(BUCKET, "integer")
        return self.spark.read.schema(schema).parquet("/".join((self.path, *at)))

    def read(self) -> DataFrame:
        """The rows after all changes that are done."""
        return self._rows(DATA).drop(BUCKET)

    def change(self, name: str, touched: DataFrame, changed: Callable[[DataFrame], DataFrame]) -> bool:
        """Rewrites the buckets of the keys in touched, and no others, by changed. False if it was done before."""
        if self._marked(name, "done"):
            return False
        if not self._marked(name, "prepared"):
            hit = touched.select(self.bucket().alias(BUCKET)).distinct().repartition(1)  # at most as many rows as there are buckets
            numbers = sorted(r[BUCKET] for r in hit.collect())
            held = self._rows(DATA).filter(F.col(BUCKET).isin(numbers))
            rows = changed(held.drop(BUCKET)).withColumn(BUCKET, self.bucket())
            rows.repartition(max(1, len(numbers)), BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{CHANGES}/{name}/rows")
            # A bucket that is left without rows has no partition among the new ones.
            self.spark.createDataFrame([(n,) for n in numbers], "bucket int").write.mode("overwrite").parquet(f"{self.path}/{CHANGES}/{name}/buckets")
            self._mark(name, "prepared")
        self._replace(name)
        self._mark(name, "done")
        return True

    def _replace(self, name: str) -> None:
        rows = self._rows(CHANGES, name, "rows")
        full = {r[BUCKET] for r in rows.select(BUCKET).distinct().collect()}
        rows.repartition(max(1, len(full)), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/{DATA}")
        for r in self.spark.read.parquet(f"{self.path}/{CHANGES}/{name}/buckets").collect():
            if r[BUCKET] not in full:
                self._fs.delete(self._at(DATA, f"{BUCKET}={r[BUCKET]}"), True)

    def insert(self, name: str, rows: DataFrame) -> bool:
        """New rows; a key that is there already, or twice among them, is an error and changes nothing."""
        one = rows.groupBy(*self.keys).count().filter("count > 1")
        if not self._marked(name, "prepared") and not (one.isEmpty() and rows.join(self.read(), self.keys, "left_semi").isEmpty()):
            raise ValueError("a key is there already")
        return self.change(name, rows, lambda held: held.unionByName(rows.select(*held.columns)))

    def upsert(self, name: str, rows: DataFrame, insert_only: tuple[str, ...] = ()) -> bool:
        return self.change(name, rows, lambda held: dml.upsert(held, rows, self.keys, insert_only))

    def update(self, name: str, where: Column, values: dict[str, Column]) -> bool:
        """Sets columns of the rows for which where holds; a value can be null, and sees the row as it was."""
        hit = F.coalesce(where, F.lit(False))

        def changed(held: DataFrame) -> DataFrame:
            kinds = {f.name: f.dataType for f in held.schema}
            return held.select(*(F.when(hit, values[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in held.columns))

        return self.change(name, self.read().filter(where), changed)

    def delete(self, name: str, where: Column) -> bool:
        return self.change(name, self.read().filter(where), lambda held: held.filter(~F.coalesce(where, F.lit(False))))


def exported(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as JSON lines in a folder of its name, and a manifest (table, file, records) beside them, made from what was written."""
    spark = next(iter(tables.values())).sparkSession
    path = path.rstrip("/")
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    counts = [spark.read.text(f"{path}/{name}").groupBy(F.lit(name).alias("table"), file.alias("file")).agg(F.count("*").alias("records")) for name in tables]
    every = counts[0]
    for x in counts[1:]:
        every = every.unionByName(x)
    every.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema("table string, file string, records bigint").json(f"{path}/manifest")
