"""Goodness of fit over dice sessions, in batch and running."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The z score and the chi-square (5 degrees of freedom, 5 %) from which a die counts as loaded.
LOADED_Z, LOADED_CHI = 2.5, 11.07


def analysis(rolls: DataFrame, change: Column | None = None) -> DataFrame:
    """Per session: size, confidence, largest |z| and its face, chi-square, loaded. Sessions under 30 rolls give zeros.

    With change the rows are changes of the counts: 1 for a roll, -1 for one taken back.
    """
    change = F.lit(1) if change is None else change
    n = rolls.groupBy("session").agg(F.sum(change).alias("n"), *(F.sum(F.when(F.col("face") == f, change).otherwise(0)).alias(f"f{f}") for f in range(1, 7)))
    return verdict(n)


def verdict(n: DataFrame, *others: str) -> DataFrame:
    """The verdict over the counts (session, n, f1 to f6) of each session; others: columns to keep."""
    some = F.nullif("n", F.lit(0))
    z = [(F.col(f"f{f}") / some - 1 / 6) / F.sqrt(F.lit(1 / 6) * (5 / 6) / some) for f in range(1, 7)]
    out = n.withColumn("z", F.array(*(F.round(F.abs(x), 6) for x in z)))
    chi = sum(((F.col(f"f{f}") - F.col("n") / 6) * (F.col(f"f{f}") - F.col("n") / 6) / (some / 6) for f in range(1, 7)), F.lit(0.0))
    enough, top = F.col("n") >= 30, F.array_max("z")
    out = out.withColumns({"confidence": F.when(F.col("n") < 30, "low").when(F.col("n") < 60, "medium").otherwise("high"), "max_z": F.when(enough, F.round(top, 2)).otherwise(0.0), "chi": F.when(enough, F.round(chi, 6)).otherwise(0.0)})
    out = out.withColumn("face", F.when(enough, F.array_position("z", top)).otherwise(0).cast("long"))
    return out.withColumn("loaded", enough & ((top >= LOADED_Z) | (F.col("chi") > LOADED_CHI))).select("session", "n", "confidence", "max_z", "face", "chi", "loaded", *others)


def running(rolls: DataFrame) -> DataFrame:
    """Chi-square after each roll of a session."""
    so_far = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rolls.withColumns({"n": F.count("*").over(so_far), **{f"f{f}": F.count_if(F.col("face") == f).over(so_far) for f in range(1, 7)}})
    squares = sum((F.col(f"f{f}") * F.col(f"f{f}") for f in range(1, 7)), F.lit(0))
    return out.select("session", "event_id", "n", F.round(squares * 6 / F.col("n") - F.col("n"), 6).alias("chi"))


def undone(rolls: DataFrame) -> DataFrame:
    """Counts by session and face, the latest roll of a session taken back: a change of -1 for it, summed with the rolls' +1."""
    latest = rolls.groupBy("session").agg(F.max_by("face", F.struct("ts", "event_id")).alias("face"))
    changes = rolls.select("session", "face", F.lit(1).alias("change")).unionByName(latest.withColumn("change", F.lit(-1)))
    return changes.groupBy("session", "face").agg(F.sum("change").alias("n"))


def remaining(actions: DataFrame) -> DataFrame:
    """actions (session, seq, face; no face takes the latest remaining roll back): session, seq, face of the rolls that remain.

    The number of rolls on the table after each action is a running sum that doesn't fall below 0; a roll has been taken back where that
    number is once less than it was right after the roll. A take-back without a roll changes nothing.
    """
    order = Window.partitionBy("session").orderBy("seq")
    so_far, later = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    rows = actions.withColumn("__sum", F.sum(F.when(F.col("face").isNull(), -1).otherwise(1)).over(so_far))
    rows = rows.withColumn("__table", F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(so_far)))
    rows = rows.withColumn("__least", F.coalesce(F.min("__table").over(later), F.col("__table")))
    return rows.filter("face is not null and __least >= __table").select("session", "seq", "face")
