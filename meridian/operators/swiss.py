"""Pairings of the next round by the Swiss system."""

from __future__ import annotations

from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _draw(ranked: list, met: dict[int, set]) -> list[tuple]:
    """(player, opponent) in table order of one bracket's upper half against its lower half, and who is left over."""
    half = len(ranked) // 2
    free = dict.fromkeys(range(half, len(ranked)))
    games, over = [], []
    for i, player in enumerate(ranked[:half]):
        own = [half + i] if half + i in free else []
        j = next((j for j in chain(own, free) if ranked[j] not in met.get(player, ())), next(iter(free), None))
        if j is None:
            over.append(player)
        else:
            del free[j]
            games.append((player, ranked[j]))
    return games, over + [ranked[j] for j in free]


def pair(standings: DataFrame, played: DataFrame) -> DataFrame:
    """standings (event, player, place, wins, losses, draws) and played (event, p1, p2): event, board, p1, p2 of the next round.

    The last of an odd number has a bye (board 0, no p2). Players of equal record meet, upper half against lower half, those who
    have not met first; who finds no opponent joins the next record's bracket. An event's draw is an ordered greedy choice, so an
    event is one task's group; events run in parallel.
    """
    sides = played.filter("p2 is not null").select("event", F.explode(F.array(F.struct(F.col("p1").alias("player"), F.col("p2").alias("opponent")), F.struct(F.col("p2").alias("player"), F.col("p1").alias("opponent")))).alias("s"))
    met = sides.groupBy("event", "s.player").agg(F.collect_set("s.opponent").alias("met"))
    last = F.row_number().over(Window.partitionBy("event").orderBy(F.desc("place")))
    count = F.count("*").over(Window.partitionBy("event"))
    rows = standings.select("event", "player", "place", F.struct("wins", "losses", "draws").alias("record"), ((count % 2 == 1) & (last == 1)).alias("bye"))
    # Brackets come by wins; of equal wins first whose best player is placed higher.
    first = F.min("place").over(Window.partitionBy("event", "record"))
    rows = rows.withColumn("bracket", F.struct((-F.col("record.wins")).alias("wins"), first.alias("first"))).join(met, ["event", "player"], "left")
    rows = rows.select("event", "player", "place", "bye", "met", F.dense_rank().over(Window.partitionBy("event").orderBy("bracket")).alias("bracket"))

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bracket", "place"])
        met = {p: set(m) for p, m in zip(group["player"], group["met"]) if m is not None}
        games, over = [], []
        for _, bracket in group[~group["bye"]].groupby("bracket", sort=True):
            found, over = _draw(over + bracket["player"].tolist(), met)
            games += found
        games += list(zip(over[::2], over[1::2]))
        out = [(board, a, b) for board, (a, b) in enumerate(games, 1)] + [(0, p, None) for p in group.loc[group["bye"], "player"]]
        return pd.DataFrame(out, columns=["board", "p1", "p2"]).astype({"p1": "Int64", "p2": "Int64"}).assign(event=group["event"].iloc[0])[["event", "board", "p1", "p2"]]

    return rows.groupBy("event").applyInPandas(draw, f"event {rows.schema['event'].dataType.simpleString()}, board int, p1 long, p2 long")


#: The missions of a round, and the one of a bye.
MISSIONS = ("Sweeping Engagement", "Priority Targets", "Scorched Earth", "Search and Destroy", "Take and Hold", "Vital Ground")
BYE = "BYE"


def of_active(pairings: DataFrame, dropped: DataFrame) -> DataFrame:
    """The pairings that count for players who have not dropped out (dropped: event, player). A result whose first player has is gone; a second one who has is no opponent, but the result stands."""
    first = pairings.join(dropped.select("event", F.col("player").alias("p1")).distinct(), ["event", "p1"], "left_anti")
    gone = dropped.select("event", F.col("player").alias("p2"), F.lit(True).alias("__gone")).distinct()
    return first.join(gone, ["event", "p2"], "left").withColumn("p2", F.when(F.col("__gone").isNull(), F.col("p2"))).select(*pairings.columns)


def mission(seed: str, *of: str):
    """The mission of a round: drawn by a digest of a seed and the round, so that it can be drawn again."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *of).cast("binary"))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % len(MISSIONS)
    return F.element_at(F.array(*map(F.lit, MISSIONS)), (place + 1).cast("int"))


def next_round(standings: DataFrame, played: DataFrame, rounds: DataFrame, seed: str) -> DataFrame:
    """The next round of each event: event, round, board, p1, p2, mission, vp1, vp2, result, confirmed.

    standings: of the active players. played: all pairings so far (event, p1, p2). rounds: event and the number of its last round. One mission
    is drawn for a round's games; the bye's row is at board 0, with no points, its result and confirmed. Games are open.
    """
    drawn = pair(standings, played).join(rounds.select("event", (F.col("round") + 1).alias("round")), "event")
    bye = F.col("p2").isNull()
    none = lambda kind: F.lit(None).cast(kind)
    points = F.when(bye, 0).otherwise(none("long"))
    return drawn.select("event", "round", "board", "p1", "p2", F.when(bye, BYE).otherwise(mission(seed, "event", "round")).alias("mission"), points.alias("vp1"), points.alias("vp2"), F.when(bye, BYE).otherwise(none("string")).alias("result"), bye.alias("confirmed"))
