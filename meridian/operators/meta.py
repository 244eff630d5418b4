"""Win rates, representation, matchups and trends over player entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.white import trimmed


def win_rate(wins: str = "wins", draws: str = "draws", games: str = "games") -> Column:
    """Draws count half; 0 without games."""
    return F.coalesce(F.try_divide(F.col(wins) + 0.5 * F.col(draws), F.col(games)), F.lit(0.0))


def rates(entries: DataFrame, keys: list[str], not_blank: str) -> DataFrame:
    """Totals by keys with win rate, and each group's share of all entries that count.

    Keys are names of factions or detachments. The window is over one row for each of them; a total by itself would read all entries again.
    """
    # Names are trimmed once for each spelling, not for each row.
    spelled = entries.groupBy(*dict.fromkeys([*keys, not_blank])).agg(*(F.sum(c).alias(c) for c in ("wins", "losses", "draws")), F.count("*").alias("players"))
    rows = spelled.filter(F.length(trimmed(not_blank)) > 0).withColumns({k: trimmed(k) for k in keys})
    out = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("wins", "losses", "draws", "players")))
    out = out.withColumn("games", F.col("wins") + F.col("losses") + F.col("draws")).withColumn("win_rate", F.round(win_rate(), 6))
    return out.withColumn("representation", F.round(F.col("players") / F.sum("players").over(Window.partitionBy(F.lit(0))), 6))


def week(day: Column) -> Column:
    """The Monday of a date (or of a text that holds one), as text; what is no date stays as it is."""
    return F.coalesce(F.date_format(F.date_trunc("week", day.try_cast("date")), "yyyy-MM-dd"), day.cast("string"))


def timeline(entries: DataFrame) -> DataFrame:
    """Weekly win rates; weeks begin on Monday. A text that is no date is its own week."""
    spelled = entries.groupBy("event_date", "faction").agg(*(F.sum(c).alias(c) for c in ("wins", "losses", "draws")))
    rows = spelled.filter(F.length(trimmed("faction")) > 0).withColumn("week", week(F.col("event_date")))
    out = rows.groupBy("week", trimmed("faction").alias("faction")).agg(*(F.sum(c).alias(c) for c in ("wins", "losses", "draws")))
    return out.withColumn("games", F.col("wins") + F.col("losses") + F.col("draws")).withColumn("win_rate", F.round(win_rate(), 6))


def matchups(entries: DataFrame) -> DataFrame:
    """In each event the player placed i meets the one placed i from the end; the better place wins, mirrors don't count."""
    n = F.count("*").over(Window.partitionBy("event"))
    rows = entries.select("event", "placement", "faction").withColumn("n", n)
    low = rows.select("event", (F.col("n") + 1 - F.col("placement")).alias("placement"), F.col("faction").alias("other"))
    pairs = rows.filter(2 * F.col("placement") <= F.col("n")).join(low, ["event", "placement"]).filter("faction <> other")
    pairs = pairs.select(F.least("faction", "other").alias("a"), F.greatest("faction", "other").alias("b"), (F.col("faction") < F.col("other")).alias("a_won"))
    return pairs.groupBy("a", "b").agg(F.count_if("a_won").alias("a_wins"), F.count("*").alias("games")).withColumn("a_win_rate", F.round(F.col("a_wins") / F.col("games"), 6))


def top_lists(entries: DataFrame, n: int | None = None) -> DataFrame:
    """Best places first, then most wins, then by event; the first n (all without n)."""
    rows = entries.orderBy("placement", F.desc("wins"), "event")
    return rows.limit(n) if n else rows
