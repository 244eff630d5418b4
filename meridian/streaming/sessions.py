"""Sessions that are closed, and verdicts that follow take-backs, as one stream (ST3, ST4).

Actions are rolls, take-backs and closes. A session's state is whether it is closed, the faces on its table (a byte each, for
take-backs) and how often each face is there, so that a batch costs its actions and not the session's past. Each batch gives a
session's counts after it, from which its verdict follows; and a row for every action that is refused: after the close, or a
take-back of nothing. Actions come in order from batch to batch, in any order within one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meridian.operators import dice
from meridian.streaming.dice import drained

FACES = [f"f{f}" for f in range(1, 7)]
CLOSED, NOTHING = "closed", "nothing to take back"
STORE = "spark.sql.streaming.stateStore.providerClass"


class _Session(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        # One state, as each read or write of one is a call to Spark.
        self.held = handle.getValueState("session", "closed long, faces string, " + ", ".join(f"{f} long" for f in FACES))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed, faces, *counts = self.held.get() or (None, "", *[0] * 6)
        table, out = list(faces), []
        actions = (a for frame in rows for a in zip(*(frame[c].tolist() for c in ("seq", "action", "face")), strict=True))
        for seq, action, face in sorted(actions, key=lambda a: a[0]):
            if action == "close":
                closed = int(seq) if closed is None else closed
            elif closed is not None or action != "roll" and not table:
                out.append((key[0], int(seq), "refused", NOTHING if closed is None else CLOSED, *[None] * 6))
            elif action == "roll":
                table.append(str(int(face)))
                counts[int(face) - 1] += 1
            else:
                counts[int(table.pop()) - 1] -= 1
        self.held.update((closed, "".join(table), *counts))
        out.append((key[0], None, "counts", None if closed is None else CLOSED, *counts))
        yield pd.DataFrame(out, columns=["session", "seq", "kind", "reason", *FACES], dtype=object)

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession):
    """States of a processor need the RocksDB store; the session's own is put back when the stream is done."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def watched(actions: DataFrame) -> DataFrame:
    """actions (session, seq, action: roll, undo or close, face): the rows of both outputs, by kind."""
    session = actions.schema["session"].dataType.simpleString()
    schema = f"session {session}, seq long, kind string, reason string, " + ", ".join(f"{f} long" for f in FACES)
    return actions.groupBy("session").transformWithStateInPandas(_Session(), schema, "Update", "None")


def outputs(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, refused) of the actions there are: each session's verdict with closed, after its latest batch; and the refused actions with the reason."""
    with _state_store(actions.sparkSession):
        rows = drained(watched(actions), "update", keep_batch=True)
    last = rows.filter("kind = 'counts'").groupBy("session").agg(F.max_by(F.struct("reason", *FACES), "batch").alias("c")).select("session", "c.*")
    counts = last.select("session", sum((F.col(f) for f in FACES), F.lit(0)).alias("n"), *FACES, F.col("reason").isNotNull().alias("closed"))
    return dice.verdict(counts, "closed"), rows.filter("kind = 'refused'").select("session", "seq", "reason")
