"""What an import of tournament results changes: accounts, ratings, history; rows without a parent are dropped and counted (G2, G3, SNK9)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.operators.ratings import NEW_PLAYER, UNKNOWN, glicko_period


def with_names(players: DataFrame) -> DataFrame:
    """players with name: their own, or their faction and placement."""
    made = F.concat(F.lit("["), F.coalesce("faction", F.lit("")), F.lit("@"), F.coalesce(F.col("placement").cast("string"), F.lit("")), F.lit("]"))
    return players.withColumn("name", F.coalesce("player", made)).filter("name <> ''")


def new_accounts(players: DataFrame, state: DataFrame, users: DataFrame) -> DataFrame:
    """(name, user) of the names that no rating has yet, without regard to case: the first spelling of each, and the account of that name."""
    first = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    rows = with_names(players).select(F.lower("name").alias("key"), "name", "seq").join(state.select(F.lower("player").alias("key")), "key", "left_anti")
    accounts = users.groupBy(F.lower("user_name").alias("key")).agg(F.min("user").alias("user"))
    return rows.withColumn("n", first).filter("n = 1").join(accounts, "key", "left").select("name", "user")


def rated(players: DataFrame, state: DataFrame, period: str) -> tuple[DataFrame, DataFrame]:
    """(state, history) after an import's players (seq, player, faction, placement, wins, losses, draws).

    state: player, rating, deviation, volatility, games, period. Every result is rated from the state before the import, against
    opponents of unknown strength; of several results of a player the last is kept. Results without a game change nothing.
    """
    known = state.select(F.lower("player").alias("key"), F.col("rating").alias("before"), F.col("deviation").alias("rd_before"), F.col("volatility").alias("v_before"), F.col("games").alias("games_before"))
    rows = with_names(players).withColumn("key", F.lower("name")).join(known, "key", "left")
    start = dict(zip(("before", "rd_before", "v_before", "games_before"), (*NEW_PLAYER, 0), strict=True))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(x)) for c, x in start.items()} | {c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in ("wins", "losses", "draws")})
    rows = rows.filter("wins + losses + draws > 0").select("seq", "key", "name", *start, "wins", "losses", "draws")
    history = _rated(rows).withColumn("period", F.lit(period)).withColumn("delta", F.col("rating") - F.col("before"))
    # Only a player's last result makes the state, so the others aren't rated for it.
    facts = ("seq", "name", *start, "wins", "losses", "draws")
    last = rows.groupBy("key").agg(F.max(F.struct(*facts)).alias("s")).select("key", *(f"s.{c}" for c in facts))
    new = _rated(last).select("key", "name", *(F.col(c).alias(f"__{c}") for c in ("rating", "deviation", "volatility")), (F.col("games_before") + F.col("wins") + F.col("losses") + F.col("draws")).alias("__games"))
    both = state.withColumn("key", F.lower("player")).join(new, "key", "full")
    pick = lambda c: F.coalesce(f"__{c}", c).alias(c)
    kept = both.select(F.coalesce("player", "name").alias("player"), *(pick(c) for c in ("rating", "deviation", "volatility", "games")), F.when(F.col("__rating").isNotNull(), F.lit(period)).otherwise(F.col("period")).alias("period"))
    return kept, history.drop("key")


def _rated(rows: DataFrame) -> DataFrame:
    """rows with rating, deviation and volatility after their games; alike states and counts are rated once."""
    facts = ["before", "rd_before", "v_before", "wins", "losses", "draws"]

    def rate(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            after = [glicko_period((r.before, r.rd_before, r.v_before), [(*UNKNOWN, s, n) for s, n in ((1.0, r.wins), (0.0, r.losses), (0.5, r.draws)) if n]) for r in part.itertuples()]
            yield part.assign(rating=[x[0] for x in after], deviation=[x[1] for x in after], volatility=[x[2] for x in after])

    schema = "before double, rd_before double, v_before double, wins int, losses int, draws int, rating double, deviation double, volatility double"
    return rows.join(rows.select(*facts).distinct().mapInPandas(rate, schema), facts)


def without_orphans(rows: DataFrame, key: list[str], order: str, parents: list[tuple[str, DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): the last row of each key, of those whose parents exist (or are null); counts: rows read, kept and dropped."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    kept = rows.withColumn("__n", last).filter("__n = 1").drop("__n")
    for child, parent, own in parents:
        known = parent.select(F.col(own).alias("__known")).distinct()
        kept = kept.join(known, F.col(child) == F.col("__known"), "left").filter(F.col(child).isNull() | F.col("__known").isNotNull()).drop("__known")
    one = lambda read, kept: (F.lit(read).cast("long").alias("read"), F.lit(kept).cast("long").alias("kept"))
    counts = rows.select(*one(1, 0)).union(kept.select(*one(0, 1))).agg(F.sum("read").alias("read"), F.sum("kept").alias("kept"))
    return kept, counts.withColumn("dropped", F.col("read") - F.col("kept"))


def versions(log: DataFrame, state: DataFrame, after: int = 0) -> DataFrame:
    """The ratings after each import of a log that it changes: version, import, player, rating, deviation, volatility, games.

    log: import, event_date and the players of an import (seq, player, faction, placement, wins, losses, draws). Imports are versions 1, 2, ... by
    event date, then id; state (player, rating, deviation, volatility, games) is that of version after, and only later imports are
    replayed. In an import every result of a player is rated from the state before it and the last one counts, as in rated(); so an import
    is one step of a player's fold, a player is one group with a row for each import, and players run in parallel.

    A log that is replayed in the order in which it happens to be stored, from ratings that already hold it, counts twice what it counts and
    depends on that order; here a replay starts from a version, so it gives the same ratings as the first time.
    """
    order = log.select("import", "event_date").groupBy("import").agg(F.min("event_date").alias("event_date"))
    order = order.withColumn("version", F.row_number().over(Window.orderBy(F.col("event_date").asc_nulls_first(), "import")))  # a row for each import
    counts = {c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in ("wins", "losses", "draws")}
    rows = with_names(log).withColumns({"key": F.lower("name"), **counts}).filter("wins + losses + draws > 0")
    step = rows.groupBy("import", "key").agg(F.max(F.struct("seq", "name", *counts)).alias("s")).select("import", "key", "s.name", *(f"s.{c}" for c in counts))
    step = step.join(order.filter(F.col("version") > after), "import")
    known = state.select(F.lower("player").alias("key"), F.col("player").alias("known"), F.col("rating").alias("r"), F.col("deviation").alias("rd"), F.col("volatility").alias("v"), F.col("games").cast("long").alias("had"))
    step = step.join(known, "key", "left")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out, rating, games, name = [], None, 0, None
        for r in rows.sort_values("version").itertuples(index=False):
            if rating is None:
                rating, games, name = (NEW_PLAYER, 0, r.name) if pd.isna(r.r) else ((r.r, r.rd, r.v), int(r.had), r.known)
            rating = glicko_period(rating, [(*UNKNOWN, s, n) for s, n in ((1.0, r.wins), (0.0, r.losses), (0.5, r.draws)) if n])
            games += r.wins + r.losses + r.draws
            out.append((r.version, r.imported, name, *rating, games))
        return pd.DataFrame(out, columns=["version", "imported", "player", "rating", "deviation", "volatility", "games"])

    kind = log.schema["import"].dataType.simpleString()
    folded = step.withColumnRenamed("import", "imported").groupBy("key").applyInPandas(fold, f"version int, imported {kind}, player string, rating double, deviation double, volatility double, games long")
    return folded.withColumnRenamed("imported", "import")


def as_of(state: DataFrame, changes: DataFrame, version: int) -> DataFrame:
    """The state (player, rating, deviation, volatility, games) after a version of the log whose changes versions() gives."""
    facts = ("rating", "deviation", "volatility", "games")
    last = changes.filter(F.col("version") <= version).groupBy(F.lower("player").alias("key")).agg(F.max_by(F.struct("player", *facts), "version").alias("s"))
    both = state.withColumn("key", F.lower("player")).join(last, "key", "full")
    return both.select(F.coalesce("player", "s.player").alias("player"), *(F.coalesce(f"s.{c}", c).alias(c) for c in facts))
