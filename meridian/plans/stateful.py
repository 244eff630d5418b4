"""Queries that keep state: ratings over periods, pairings of the next round, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators import dice, ratings, standings, swiss
from meridian.plans import folds
from meridian.plans.catalog import DICE_SQL, STANDINGS_SQL
from meridian.plans.registry import query
from meridian.sources.views import ROLLS_SQL, entries, pairings, rolls, table
from meridian.streaming import dice as streams


@query("glicko_fold", folds.GLICKO)
def glicko_fold(spark: SparkSession, d: str) -> DataFrame:
    """Factions rated by month over their entries."""
    rows = entries(spark, d).select(F.col("faction").alias("player"), F.date_format("event_date", "yyyy-MM").alias("period"), "wins", "losses", "draws")
    return ratings.glicko(rows).withColumns({c: F.round(c, 8 if c == "volatility" else 6) for c in ("before", "rating", "deviation", "volatility", "delta")})


@query("elo_step", """SELECT o_orderkey, CAST(floor(1200 + o_orderkey % 300 + 32 * (1 - 1 / (1 + pow(10, (o_custkey % 300 - o_orderkey % 300) / 400.0))) + 0.5) AS BIGINT) AS winner,
  CAST(floor(1200 + o_custkey % 300 - 32 * (1 - 1 / (1 + pow(10, (o_custkey % 300 - o_orderkey % 300) / 400.0))) + 0.5) AS BIGINT) AS loser FROM orders""")
def elo_step(spark: SparkSession, d: str) -> DataFrame:
    """One game between players of known ratings, as expressions."""
    a, b = 1200 + F.col("o_orderkey") % 300, 1200 + F.col("o_custkey") % 300
    gain = 32 * (1 - 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400)))
    return table(spark, d, "orders").select("o_orderkey", F.floor(a + gain + 0.5).alias("winner"), F.floor(b - gain + 0.5).alias("loser"))


@query("swiss_pairings", folds.swiss(STANDINGS_SQL))
def swiss_pairings(spark: SparkSession, d: str) -> DataFrame:
    """The next round of every month's event."""
    games = pairings(spark, d)
    return swiss.pair(standings.standings(games), games.select("event", "p1", "p2"))


@query("dice_undo", f"WITH {ROLLS_SQL}, r AS (SELECT session, face, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS back FROM rolls) SELECT session, face, count(*) FILTER (back > 1) AS n FROM r GROUP BY 1, 2")
def dice_undo(spark: SparkSession, d: str) -> DataFrame:
    """Counts by face after each session's latest roll is taken back."""
    return dice.undone(rolls(spark, d))


@query("stream_running_verdict", DICE_SQL)
def stream_running_verdict(spark: SparkSession, d: str) -> DataFrame:
    return streams.drained(streams.verdicts(streams.roll_stream(spark, d)), "update", ["session"])


@query("stream_stability", folds.STABILITY)
def stream_stability(spark: SparkSession, d: str) -> DataFrame:
    """Settled counts over each user's events as frames, two equal frames settling a count."""
    frames = streams.event_stream(spark, d).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.get_json_object("props", "$.k").cast("long") % 3).alias("found"))
    return streams.drained(streams.settled(frames, last=2, empty=1), "append")


TAKE_BACKS = f"""{ROLLS_SQL}, s AS (SELECT session, event_id, CASE WHEN event_id % 3 > 0 THEN face END AS face, sum(CASE WHEN event_id % 3 > 0 THEN 1 ELSE -1 END) OVER (PARTITION BY session ORDER BY event_id) AS s FROM rolls),
t AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY session ORDER BY event_id)) AS t FROM s),
l AS (SELECT *, min(t) OVER (PARTITION BY session ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM t WHERE true),
kept AS (SELECT session, event_id, face, coalesce(later, t) >= t AS stays FROM l WHERE face IS NOT NULL)"""


def _actions(events: DataFrame) -> DataFrame:
    """Each third event takes a roll back."""
    return events.select("session", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 > 0, F.col("face")).cast("long").alias("face"))


@query("dice_remaining", f"WITH {TAKE_BACKS} SELECT session, event_id AS seq, CAST(face AS BIGINT) AS face FROM kept WHERE stays")
def dice_remaining(spark: SparkSession, d: str) -> DataFrame:
    return dice.remaining(_actions(rolls(spark, d)))


@query("stream_retraction", DICE_SQL.replace(ROLLS_SQL, TAKE_BACKS).replace("count(*) AS n", "count(*) FILTER (stays) AS n").replace("FILTER (face", "FILTER (stays AND face").replace("FROM rolls GROUP", "FROM kept GROUP"))
def stream_retraction(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts over the rolls that remain, from the changes that a stream of rolls and take-backs gives."""
    return dice.analysis(streams.drained(streams.changes(_actions(streams.roll_stream(spark, d))), "append"), F.col("change"))
