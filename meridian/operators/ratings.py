"""Rating models: unit ratings with grades, and Elo as an ordered fold."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grade(share: Column) -> Column:
    return F.when(share >= 0.75, "S").when(share >= 0.60, "A").when(share >= 0.45, "B").when(share >= 0.30, "C").otherwise("D")


def unit_ratings(uses: DataFrame, least: int = 3) -> DataFrame:
    """uses (unit, won, points): games, share of wins, mean points (100 without any), efficiency and grade of units with enough games."""
    out = uses.groupBy("unit").agg(F.count("*").alias("games"), F.count_if("won").alias("wins"), F.coalesce(F.avg("points"), F.lit(100.0)).alias("avg_points")).filter(F.col("games") >= least)
    share = F.col("wins") / F.col("games")
    return out.withColumns({"contribution": F.round(share, 6), "efficiency": F.round(F.try_divide(share, F.col("avg_points")) * 100, 6), "grade": grade(share)}).withColumn("avg_points", F.round("avg_points", 6))


def elo(games: DataFrame, start: float = 1200.0) -> DataFrame:
    """games (pool, seq, p1, p2, score): each player's rating after all games of a pool, in order. 32 points at stake below 30 games, else 16.

    Both players of a game change, so a pool is one ordered fold; pools run in parallel.
    """

    def fold(rows):
        rating: dict[int, float] = {}
        played: dict[int, int] = {}
        for a, b, s in rows.sort_values("seq")[["p1", "p2", "score"]].itertuples(index=False):
            ra, rb = rating.get(a, start), rating.get(b, start)
            expected = 1 / (1 + 10 ** ((rb - ra) / 400))
            for p, old, gain in ((a, ra, s - expected), (b, rb, expected - s)):
                k = 32 if played.get(p, 0) < 30 else 16
                rating[p] = float(math.floor(old + k * gain + 0.5))
                played[p] = played.get(p, 0) + 1
        return pd.DataFrame({"pool": rows["pool"].iloc[0], "player": list(rating), "rating": list(rating.values()), "games": [played[p] for p in rating]})

    return games.groupBy("pool").applyInPandas(fold, "pool string, player long, rating double, games long")


#: Fixed values of the Glicko-2 scale: where it is centred, its unit, how much volatility may change, where its search ends; a new player's state and the opponent that stands for unknown ones.
CENTRE, UNIT, TAU, CLOSE = 1500.0, 173.7178, 0.5, 1e-6
NEW_PLAYER, UNKNOWN = (1500.0, 350.0, 0.06), (1500.0, 200.0)


def glicko_period(state: tuple[float, float, float], games: list[tuple[float, float, float, int]]) -> tuple[float, float, float]:
    """A rating (rating, deviation, volatility) after a period's games (opponent's rating and deviation, score, how many alike)."""
    rating, deviation, volatility = state
    mu, phi = (rating - CENTRE) / UNIT, deviation / UNIT
    information = gain = 0.0
    for other, spread, score, times in games:
        p = spread / UNIT
        g = 1 / math.sqrt(1 + 3 * p * p / math.pi**2)
        e = 1 / (1 + math.exp(-g * (mu - (other - CENTRE) / UNIT)))
        information += times * g * g * e * (1 - e)
        gain += times * g * (score - e)
    if information == 0:
        return rating, UNIT * math.sqrt(phi * phi + volatility**2), volatility
    v = 1 / information
    centre, excess = math.log(volatility**2), (v * gain) ** 2 - phi * phi - v

    def slope(x: float) -> float:
        s = math.exp(x)
        return s * (excess - s) / (2 * (phi * phi + v + s) ** 2) - (x - centre) / TAU**2

    low = centre
    if excess > 0:
        high = math.log(excess)
    else:
        k = 1
        while slope(centre - k * TAU) < 0:
            k += 1
        high = centre - k * TAU
    f_low, f_high = slope(low), slope(high)
    while abs(high - low) > CLOSE:
        x = low + (low - high) * f_low / (f_high - f_low)
        f = slope(x)
        low, f_low = (high, f_high) if f * f_high <= 0 else (low, f_low / 2)
        high, f_high = x, f
    volatility = math.exp(low / 2)
    phi = 1 / math.sqrt(1 / (phi * phi + volatility**2) + 1 / v)
    return CENTRE + UNIT * (mu + phi * phi * gain), UNIT * phi, volatility


@lru_cache(2**16)
def _after(state: tuple[float, float, float], times: tuple[int, int, int]) -> tuple[float, float, float]:
    """A rating after as many wins, losses and draws against unknown opponents."""
    return glicko_period(state, [(*UNKNOWN, s, n) for s, n in zip((1.0, 0.0, 0.5), times, strict=True) if n])


def glicko(results: DataFrame) -> DataFrame:
    """results (player, period, wins, losses, draws): each player's rating before and after every period, against opponents of unknown strength.

    Counts are summed by player and period before the shuffle, so a player has one row a period; they are folded as a task's sorted rows
    go by, without a group for each player. Null counts are 0; a period without games makes the deviation grow; rows without a player or
    a period are left out.
    """
    counts = ("wins", "losses", "draws")
    per = results.filter("player is not null and period is not null").groupBy("player", "period").agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).cast("int").alias(c) for c in counts))
    names = ["player", "period", "before", "rating", "deviation", "volatility", "delta"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A player's periods follow each other and may go on in the next batch; many players have the same counts from the same state.
        last, state = None, NEW_PLAYER
        for batch in batches:
            before, after = [], []
            for player, *times in zip(*(batch[c].tolist() for c in ("player", *counts)), strict=True):
                if player != last:
                    last, state = player, NEW_PLAYER
                before.append(state[0])
                state = _after(state, tuple(times))
                after.append(state)
            out = batch[["player", "period"]].assign(before=before)
            out[["rating", "deviation", "volatility"]] = np.array(after, float).reshape(-1, 3)
            yield out.assign(delta=out["rating"] - out["before"])[names]

    kinds = {c: per.schema[c].dataType.simpleString() for c in ("player", "period")}
    dealt = per.repartition("player").sortWithinPartitions("player", "period")
    return dealt.mapInPandas(fold, f"player {kinds['player']}, period {kinds['period']}, before double, rating double, deviation double, volatility double, delta double")
