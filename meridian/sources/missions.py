"""Mission names out of the text of rule books (SRC16, S12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.text import replaced, title
from meridian.functions.white import trimmed

#: The kinds of cards with their file and what stands round a name, and names of other cards that may follow a challenger's.
CARDS = [
    ("primary", "primary-missions.md", r"([A-Z][A-Z '’]+?)\s+PRIMARY MISSION"),
    ("secondary", "secondary-missions-attacker.md", r"([A-Z][A-Z '’]+?)\s+(?:FIXED - )?SECONDARY MISSION"),
    ("deployment_zone", "deployment-zones.md", r"([A-Z][A-Z\s]+?)(?:\s+(?:INCURSION|STRIKE FORCE|ASYMMETRIC WAR))"),
    ("twist", "twist-cards.md", r"([A-Z][A-Z '’]+?)\s+TWIST\b"),
    ("challenger", "challenger-cards.md", r"([A-Z][A-Z '’]+?)\s+CHALLENGER MISSION"),
]
FOLLOWING = ["PIVOTAL MOMENT", "HARBORED POWER", "RENEWED FOCUS", "BURST OF SPEED", "GREAT HASTE", "FORCE A BREACH", "ALL IN", "OPPORTUNISTIC STRIKE", "STRATEGIC RETREAT"]
AROUND = [(r"^.*\bVP\s+", ""), (r"(?i)(?:FOR PLAYERS USING (?:TACTICAL|FIXED) MISSIONS\s*)+", ""), (r"^(?:AND|OR)\s+", ""), (r"^\s*↑↓\s*", "")]
#: Kinds of which a name counts once.
ONCE = ("deployment_zone", "challenger")


def mission_name(raw: Column) -> Column:
    """A name without scores, conditions, connectives and arrows before it."""
    return trimmed(replaced(raw, AROUND))


def challenger_name(raw: Column) -> Column:
    return trimmed(reduce(lambda x, s: F.regexp_replace(x, rf"(?i)\s+{s}$", ""), FOLLOWING, mission_name(raw)))


def missions(files: DataFrame) -> DataFrame:
    """files (file, value: a whole file, or a folder's part of that name): id, name, kind in the order of the cards; other files give no rows."""
    names = {"deployment_zone": trimmed, "challenger": challenger_name}
    cards = [
        F.when(F.col("file").rlike(rf"(?:^|/){at.replace('.', '[.]')}(?:/[^/]*)?$"), F.struct(F.lit(k).alias("deck"), F.lit(kind).alias("kind"), F.transform(F.regexp_extract_all("value", F.lit(p), F.lit(1)), names.get(kind, mission_name)).alias("names")))
        for k, (kind, at, p) in enumerate(CARDS)
    ]
    rows = files.select("file", F.coalesce(*cards).alias("card")).select("file", "card.deck", "card.kind", F.posexplode("card.names").alias("pos", "name"))
    rows = rows.filter((F.col("kind") == "deployment_zone") | (F.length("name") > 2)).withColumn("name", title(F.col("name")))
    once = F.when(F.col("kind").isin(*ONCE), F.col("name")).otherwise(F.concat_ws(":", "file", F.col("pos").cast("string")))
    first = rows.groupBy("deck", "kind", once.alias("once")).agg(F.min(F.struct("file", "pos", "name")).alias("m"))
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy("deck").orderBy("m.file", "m.pos")))
    # Five rows at most.
    before = first.groupBy("deck").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("deck").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return numbered.join(before, "deck").select(F.concat(F.lit("mission-"), (F.col("before") + F.col("n")).cast("string")).alias("id"), F.col("m.name").alias("name"), "kind")
