"""Readers of tournament results in CSV (SRC4 to SRC8) and of JSON arrays (SRC14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions.white import WHITE, trimmed
from meridian.functions import parse

#: What each site calls its columns, in order of precedence.
SITE_A = {
    "placement": ["place", "placement", "rank", "finish"], "player": ["name", "player", "player name", "player_name"], "faction": ["faction", "army", "faction/army"],
    "detachment": ["detachment", "sub_faction", "sub faction", "subfaction"], "wins": ["w", "wins", "win"], "losses": ["l", "losses", "loss"], "draws": ["d", "draws", "draw"],
    "points": ["points", "total points", "vp", "total vp", "tournament points"], "list": ["list", "army list", "list text", "roster"],
}
SITE_B = SITE_A | {
    "placement": ["rank", "place", "placement", "finish", "position"], "player": ["player", "name", "player name", "player_name"], "points": ["cp", "championship points", "vp", "points", "total", "tournament points"],
}
GENERIC = {
    "event": ["event_name", "event name", "event"], "event_date": ["event_date", "event date", "date"], "format": ["format", "event_format", "event format"],
    "placement": ["placement", "place", "rank", "finish"], "player": ["player_name", "player name", "player", "name"], "faction": ["faction", "army"],
    "detachment": ["detachment", "sub_faction", "sub faction", "subfaction"], "wins": ["wins", "w", "win"], "losses": ["losses", "l", "loss"], "draws": ["draws", "d", "draw"],
    "points": ["points", "vp", "total_points", "total points"], "list": ["list_text", "list text", "list", "army list"], "unit": ["unit_name", "unit name", "unit"],
    "content": ["content_id", "content id", "bsdata_id"], "unit_games": ["unit_games_played", "games_played", "games played"], "unit_points": ["unit_avg_points", "avg_points", "avg points", "average points"],
}
COUNTS = ("wins", "losses", "draws", "points")


def cells(line: Column) -> Column:
    """The fields of a line, which holds no line feed: without their quotes (of doubled ones in quotes one is left) and without white space around them.

    Each quote opens or closes; commas between two part nothing, and quotes that nothing closes reach to the line's end. A null line is an empty one, and fields
    are never null: a filter of nulls would move below the column that has them, and cut each line again.
    """
    # Cut at quotes, each second piece was in them, and an empty piece between two of those was a doubled quote. Line feeds then stand for the commas that part.
    between = lambda p, i, pieces: F.when((p == "") & (i > 0) & (i < F.size(pieces) - 1), F.lit('"')).otherwise(F.replace(p, F.lit(","), F.lit("\n")))
    parted = lambda pieces: F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, p).otherwise(between(p, i, pieces))), "")
    # An array of one array, so that the pieces are cut once and not for each use of them.
    line = F.coalesce(F.get(F.transform(F.array(F.split(line, '"')), parted), F.lit(0)), F.lit(""))
    # A look at its ends tells of most fields that there is nothing to trim; the trim takes longer.
    plain = lambda c: (c >= "!") & (c < "\x7f")
    return F.transform(F.split(line, "\n"), lambda c: F.when(plain(c) & plain(F.right(c, F.lit(1))), c).otherwise(trimmed(c)))


def _names(header: Column) -> Column:
    return F.transform(cells(header), F.lower)


def _places(names: str, aliases: dict[str, list[str]]) -> Column:
    """Where the fields of aliases, in their order, stand in a line: each the place of its first name among names, null where it has none."""
    known = F.array(*(F.array(*map(F.lit, of)) for of in aliases.values()))
    return F.transform(known, lambda of: (F.array_position(names, F.get(F.filter(of, lambda n: F.array_contains(names, n)), F.lit(0))) - 1).cast("int"))


def lines(files: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """A row for each line after the header of files (whole_files or file_lines gives them), its trimmed fields under the names of aliases; absent ones are null.

    Lines are in the order of column line within a file: a number from whole files, a place from lines.
    """
    if "value" in files.columns:
        body = F.filter(F.split("value", r"\r?\n"), lambda x: F.length(trimmed(x)) > 0)
        rows = files.select("file", body.alias("body")).filter(F.size("body") > 1)
        # The header before the lines are dealt out, so that no line carries the file along.
        rows = rows.select("file", _names(F.get("body", F.lit(0))).alias("names"), F.slice("body", 2, F.size("body")).alias("body"))
        rows = rows.select("file", _places("names", aliases).alias("at"), F.posexplode("body").alias("line", "text")).select("file", "at", "line", cells(F.col("text")).alias("cells"))
    else:
        body = files.filter(F.col("text").rlike(f"[^{WHITE}]"))
        headers = body.groupBy("file").agg(F.min(F.struct("line", "text")).alias("h")).select("file", F.col("h.line").alias("__first"), _names(F.col("h.text")).alias("names"))
        headers = headers.select("file", "__first", _places("names", aliases).alias("at"))
        # Fields are cut before the join: filters of them move into it, and would cut each line again.
        rows = body.select("file", "line", cells(F.col("text")).alias("cells")).join(F.broadcast(headers), "file").filter(F.col("line") > F.col("__first"))
    return rows.select("file", "line", *(F.get("cells", F.get("at", F.lit(i))).alias(c) for i, c in enumerate(aliases)))


def _players(rows: DataFrame, extra: list[Column]) -> DataFrame:
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(*extra, "file", "line", parse.leading_int(F.col("placement")).alias("placement"), blank("player").alias("player"), F.coalesce("faction", F.lit("")).alias("faction"), blank("detachment").alias("detachment"), *(F.coalesce(parse.leading_int(F.col(c)), F.lit(0)).alias(c) for c in COUNTS), blank("list").alias("list"))


def whole_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("file"), "value")


def file_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Lines of files (file, line, text), so that a large file is dealt over tasks. A line's place is where its split of the file starts, and a number that grows within the split."""
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("number"))
    # Only line feeds end lines, as in whole files; a carriage return before one is trimmed.
    return spark.read.text(path, lineSep="\n", pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("file"), place.alias("line"), F.col("value").alias("text"))


def site_results(files: DataFrame, aliases: dict[str, list[str]], event: str, event_date: str, format: str = "GT") -> DataFrame:
    """Players of one event's files; rows without a whole number for the place are left out, unreadable counts are 0."""
    return _players(lines(files, aliases), [F.lit(event).alias("event"), F.lit(event_date).alias("event_date"), F.lit(format).alias("format")]).filter("placement is not null")


def generic_results(files: DataFrame) -> DataFrame:
    """Players of many events with their units: the first row of an (event, place, faction) gives the player, every row may add a unit.

    Rows without event or date are left out; an event has the format of its first row, GT where there is no such column.
    """
    rows = lines(files, GENERIC).filter("event <> '' and event_date <> ''")
    unit = F.when(F.length("unit") > 0, F.struct("unit", F.nullif("content", F.lit("")).alias("content"), F.coalesce(parse.leading_int(F.col("unit_games")), F.lit(0)).alias("games"), F.coalesce(F.col("unit_points").try_cast("double"), F.lit(0.0)).alias("points")))
    rows = _players(rows, [F.col("event"), F.col("event_date"), F.coalesce("format", F.lit("GT")).alias("format"), unit.alias("__unit")])
    # Both windows go over rows dealt and sorted once, by event first, as its names differ early; rows without a place may still give an event's format.
    event = ["event", "event_date", "file"]
    rows = rows.repartition(*event)
    of_player = Window.partitionBy(*event, "placement", "faction").orderBy("line")
    rows = rows.withColumns({"__n": F.row_number().over(of_player), "__units": F.collect_list("__unit").over(of_player.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}).filter("__n = 1")
    rows = rows.withColumn("format", F.min(F.struct("line", "format")).over(Window.partitionBy(*event))["format"]).filter("placement is not null")
    return rows.select("file", "event", "event_date", "format", "placement", "faction", "player", "detachment", *COUNTS, "list", F.when(F.size("__units") > 0, F.col("__units")).alias("units"))


#: How raw results of each format are read; the two sites' files don't name their event.
FORMATS = {
    "site_a": lambda files, event="Imported event", date="1970-01-01": site_results(files, SITE_A, event, date),
    "site_b": lambda files, event="Imported event", date="1970-01-01": site_results(files, SITE_B, event, date),
    "generic": lambda files, *_: generic_results(files),
}


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of files that hold one JSON array each; other files and broken ones give no rows."""
    files = whole_files(spark, path).filter(F.col("value").rlike(r"^\s*\["))
    return files.select("file", F.explode(F.from_json("value", f"array<{schema}>", {"mode": "PERMISSIVE"})).alias("r")).filter("r is not null").select("file", "r.*")


def json_unread(spark: SparkSession, path: str) -> DataFrame:
    """file, reason of the files that json_rows reads nothing from: no array, or an array that can't be read. A file without a byte is none to Spark."""
    value = F.col("value")
    reason = F.when(~value.rlike(r"^\s*\["), "no array").when(F.try_parse_json(value).isNull(), "broken")
    return whole_files(spark, path).select("file", reason.alias("reason")).filter("reason is not null")
