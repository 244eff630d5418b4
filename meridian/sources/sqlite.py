"""SQLite files as a source (SRC15): spark.dataSource.register(Sqlite), then spark.read.format("sqlite").option("table", "t").load(path)."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DataType, DoubleType, LongType, StringType, StructField, StructType

#: The affinity that a declared type has by the letters in it, the first that holds, as Spark's type and SQLite's.
AFFINITY = [("INT", LongType(), "INTEGER"), ("CHAR", StringType(), "TEXT"), ("CLOB", StringType(), "TEXT"), ("TEXT", StringType(), "TEXT"), ("BLOB", BinaryType(), "BLOB"), ("REAL", DoubleType(), "REAL"), ("FLOA", DoubleType(), "REAL"), ("DOUB", DoubleType(), "REAL")]
ARROW = {LongType(): pa.int64(), StringType(): pa.string(), BinaryType(): pa.binary(), DoubleType(): pa.float64()}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    return con


def _type(declared: str) -> tuple[DataType, str]:
    """Columns without one of these letters are read as text, so nothing is lost."""
    return next(((spark, own) for letters, spark, own in AFFINITY if letters in declared.upper()), (StringType(), "TEXT"))


@dataclass
class RowIds(InputPartition):
    first: int
    last: int


class Sqlite(DataSource):
    """A table of a database file that all executors can read (a shared mount), in ranges of row ids read in parallel.

    Options: table; rows, the row ids of a task (100,000). Columns have the type of their declared affinity, values are cast to it.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        con = _open(self.options["path"])
        found = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        con.close()
        if not found:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return StructType([StructField(c[1], _type(c[2])[0]) for c in found])

    def reader(self, schema: StructType) -> DataSourceReader:
        return Ranges(self.options["path"], self.options["table"], int(self.options.get("rows", "100000")), schema)


class Ranges(DataSourceReader):
    def __init__(self, path: str, table: str, rows: int, schema: StructType):
        self.path, self.table, self.rows, self.schema = path, table, rows, schema

    def partitions(self) -> list[InputPartition]:
        con = _open(self.path)
        least, most = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        con.close()
        return [RowIds(a, min(a + self.rows - 1, most)) for a in range(least, most + 1, self.rows)] if least is not None else [RowIds(0, -1)]

    def read(self, partition: RowIds) -> Iterator[pa.RecordBatch]:
        own = {spark: name for _, spark, name in AFFINITY}
        columns = ", ".join(f"CAST({_quoted(f.name)} AS {own[f.dataType]})" for f in self.schema)
        fields = pa.schema([(f.name, ARROW[f.dataType]) for f in self.schema])
        con = _open(self.path)
        rows = con.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (partition.first, partition.last))
        while part := rows.fetchmany(10000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), fields.types)], schema=fields)
        con.close()
