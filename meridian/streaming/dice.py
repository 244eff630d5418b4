"""Dice sessions as streams: running verdicts and the capture of settled throws (ST1 to ST3)."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from meridian.operators import dice
from meridian.sources.views import roll_columns

#: Frames that a count must last to be captured, and empty frames before the next capture.
SETTLED, EMPTY = 20, 10


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they come, from the file or folder of that name; a pattern for that one name, as a stream of a plain path has to be a folder."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/event[s].parquet")


def roll_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll_columns(event_stream(spark, sf_dir))


def verdicts(rolls: DataFrame) -> DataFrame:
    """Each session's verdict over all rolls so far; in update mode a row for each session that got rolls."""
    return dice.analysis(rolls)


def settled(frames: DataFrame, last: int = SETTLED, empty: int = EMPTY) -> DataFrame:
    """frames (session, seq, found): session, seq, found of every capture.

    A count that stays for last frames after its first is captured; then only empty frames count, and after as many as empty says the
    watch begins anew. The state of a session is three numbers; frames come in order from batch to batch, in any order within one.
    """
    kind = frames.schema["session"].dataType.simpleString()

    def watch(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        same, pause, before = state.get if state.exists else (0, 0, 0)
        out = []
        for seq, found in pd.concat(list(batches)).sort_values("seq")[["seq", "found"]].itertuples(index=False):
            if pause:
                pause -= found == 0
            elif found and found == before:
                same += 1
                if same >= last:
                    out.append((key[0], seq, found))
                    same, pause = 0, empty
            else:
                same, before = 0, found
        state.update((int(same), int(pause), int(before)))
        yield pd.DataFrame(out, columns=["session", "seq", "found"])

    return frames.groupBy("session").applyInPandasWithState(watch, f"session {kind}, seq long, found long", "same long, pause long, before long", "append", GroupStateTimeout.NoTimeout)


def changes(actions: DataFrame) -> DataFrame:
    """actions (session, seq, face; no face takes the latest remaining roll back): session, face, change, 1 for each roll and -1 for each taken back.

    A session's state is the faces on its table, a byte each; actions come in order from batch to batch, in any order within one. Sums of
    the changes are the counts after the take-backs; a take-back without a roll gives no row.
    """
    kind = actions.schema["session"].dataType.simpleString()

    def watch(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (faces,) = state.get if state.exists else ("",)
        table, out = list(faces), []
        for face in pd.concat(list(batches)).sort_values("seq")["face"]:
            if pd.notna(face):
                table.append(str(int(face)))
                out.append((key[0], int(face), 1))
            elif table:
                out.append((key[0], int(table.pop()), -1))
        state.update(("".join(table),))
        yield pd.DataFrame(out, columns=["session", "face", "change"])

    return actions.groupBy("session").applyInPandasWithState(watch, f"session {kind}, face long, change long", "faces string", "append", GroupStateTimeout.NoTimeout)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; below the warehouse where that is unset."""
    try:
        root = spark.conf.get("spark.checkpoint.dir")
    except PySparkException:
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def in_batches(rows: DataFrame, batches: list) -> DataFrame:
    """A table's rows as a stream, a batch for each of the conditions in turn; the files are written to the shared folder, one set after the other."""
    spark = rows.sparkSession
    at = shared_folder(spark, "batches")
    for k, where in enumerate(batches):
        # A file for each batch, as a batch is a file of the stream; sources of that kind order files by their time.
        rows.filter(where).repartition(1).write.parquet(f"{at}/{k:06d}")
        time.sleep(0.01)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/*")


def drained(stream: DataFrame, mode: str, keys: list[str] | None = None, keep_batch: bool = False) -> DataFrame:
    """What a stream gives for the input there is, as a table in the shared folder; of each key (if any) the latest batch's row. keep_batch: with the number of each row's batch.

    Batches are files by batch id, so one that runs again after a failure replaces its own.
    """
    spark = stream.sparkSession
    at = shared_folder(spark, "stream")
    # An empty table first, for a stream without input.
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/rows/batch=-1")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/rows/batch={n}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = spark.read.option("basePath", f"{at}/rows").parquet(f"{at}/rows")
    if keep_batch:
        return rows
    if not keys:
        return rows.drop("batch")
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("__latest", latest).filter("__latest = 1").drop("__latest", "batch")
