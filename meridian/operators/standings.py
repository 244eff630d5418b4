"""Standings, strength of schedule and player totals over pairings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sides(pairings: DataFrame) -> DataFrame:
    """A row for each player of a pairing: player, opponent, points for and against, won, lost, drew."""
    side = lambda p, o, v, w, win: F.struct(F.col(p).alias("player"), F.col(o).alias("opponent"), F.col(v).alias("vp"), F.col(w).alias("vp_against"), (F.col("result") == win).cast("long").alias("won"))
    rows = pairings.select("event", "result", F.explode(F.array(side("p1", "p2", "vp1", "vp2", "P1"), side("p2", "p1", "vp2", "vp1", "P2"))).alias("s")).select("event", "result", "s.*").filter("player is not null")
    bye, drew = F.col("result") == "BYE", (F.col("result") == "DRAW").cast("long")
    return rows.withColumns({"won": F.when(bye, 1).otherwise(F.col("won")).cast("long"), "drew": drew, "vp": F.when(bye, 0).otherwise(F.col("vp")), "vp_against": F.when(bye, 0).otherwise(F.col("vp_against"))}).withColumn("lost", 1 - F.col("won") - F.col("drew"))


def standings(pairings: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """Places by wins, margin, strength of schedule and points; the schedule's strength is the opponents' mean share of wins.

    players: (event, player) of all who take part, also without a pairing; without it those of the pairings.
    """
    rows = sides(pairings)
    record = rows.groupBy("event", "player").agg(F.sum("won").alias("wins"), F.sum("lost").alias("losses"), F.sum("drew").alias("draws"), F.sum("vp").alias("vp"), F.sum(F.col("vp") - F.col("vp_against")).alias("margin"), F.count("*").alias("games"))
    met = rows.filter("opponent is not null").select("event", "player", "opponent")
    other = record.select("event", F.col("player").alias("opponent"), (F.col("wins") / F.col("games")).alias("share"))
    strength = met.join(other, ["event", "opponent"]).groupBy("event", "player").agg(F.avg("share").alias("sos"))
    if players is not None:
        record = players.select("event", "player").distinct().join(record, ["event", "player"], "left").na.fill(0)
    out = record.join(strength, ["event", "player"], "left").withColumn("sos", F.round(F.coalesce("sos", F.lit(0.0)), 6))
    place = Window.partitionBy("event").orderBy(F.desc("wins"), F.desc("margin"), F.desc("sos"), F.desc("vp"), "player")
    return out.withColumn("place", F.row_number().over(place))
