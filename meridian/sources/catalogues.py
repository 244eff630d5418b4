"""Reader of unit catalogues in XML (SRC9, SRC10, X1 to X9, Q1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions import parse

#: A unit's characteristics and a weapon's, what catalogues call them, and what counts where none is given.
TRAITS = {"move": (["M", "Move"], "0"), "toughness": (["T", "Toughness"], "0"), "save": (["Sv", "SV", "Save"], "0"), "wounds": (["W", "Wounds"], "1"), "leadership": (["Ld", "LD", "Leadership"], "6"), "control": (["OC", "Objective Control"], "1")}
ARMS = {"range": (["Range"], "0"), "attacks": (["A", "Attacks"], "1"), "skill": (["BS", "WS", "Skill"], "4"), "strength": (["S", "Strength"], "4"), "ap": (["AP"], "0"), "damage": (["D", "Damage"], "1"), "abilities": (["Abilities", "Special Rules", "Keywords", "Special", "Rules Text", "Type"], "")}
UNIT, WEAPON = r"(?i)^(?:Unit|Model)(?: ?Characteristics?)?$", r"(?i)^(?:Ranged Weapons?|Melee Weapons?|Weapon)$"
INVULNERABLE = [r"(?i)([2-6])\+\s*invulnerable\s+save", r"(?i)invulnerable\s+save\s+(?:of\s+)?([2-6])\+", r"(?i)invulnerable\s+save\s*\(\s*([2-6])\+\s*\)"]
NO_PAIN = [r"(?i)feel\s+no\s+pain\s+([2-6])\+", r"(?i)feel\s+no\s+pain\s*\(\s*([2-6])\+\s*\)", r"(?i)([2-6])\+\s*feel\s+no\s+pain"]


#: An entry's fields, and the XML of its other children as text, which the reader writes in one way: no white space but one space before an attribute, no empty tags.
_FIELDS = "_id string, _name string, _type string, costs struct<cost: array<struct<_name: string, _value: double>>>, inner array<string>"
_END = r'(?= [\w:.-]+="|>)'  # after an attribute's closing quote; quotes and signs within a value come decoded
_TAG = rf'(?: [\w:.-]+="[\s\S]*?"{_END})*>'


def _attribute(xml: Column, name: str) -> Column:
    return F.regexp_extract(F.regexp_extract(xml, rf"^<\w+{_TAG}", 0), rf' {name}="([\s\S]*?)"{_END}', 1)


def _profiles(xml: Column) -> Column:
    """All profiles in a text at any depth, each (name, kind, traits)."""
    elements = lambda x, tag: F.regexp_extract_all(x, F.lit(rf"<{tag}{_TAG}[\s\S]*?</{tag}>"), F.lit(0))
    trait = lambda c: F.struct(_attribute(c, "name").alias("name"), F.nullif(F.regexp_extract(c, rf"^<\w+{_TAG}([\s\S]*)</characteristic>$", 1), F.lit("")).alias("value"))
    return F.transform(elements(xml, "profile"), lambda p: F.struct(_attribute(p, "name").alias("name"), _attribute(p, "type(?:Name)?").alias("kind"), F.transform(elements(p, "characteristic"), trait).alias("traits")))


def _own(xml: Column) -> Column:
    """A text without the entries in it, which may hold others."""
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + part.rlike("^<selectionEntry[ >]").cast("int")
        return F.struct((depth - F.endswith(part, F.lit("</selectionEntry>")).cast("int")).alias("depth"), F.when(depth > 0, acc["kept"]).otherwise(F.array_append(acc["kept"], part)).alias("kept"))

    return F.aggregate(F.split(xml, "(?=<selectionEntry[ >])|(?<=</selectionEntry>)"), start, step, lambda acc: F.array_join(acc["kept"], ""))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def _trait(profile: Column, names: list[str], default: str) -> Column:
    called = lambda n: F.get(F.filter(profile["traits"], lambda c: F.trim(c["name"]) == n), F.lit(0))["value"]
    return F.trim(F.coalesce(*(called(n) for n in names), F.lit(default)))


def _weapon(profile: Column) -> Column:
    at = {k: _trait(profile, names, default) for k, (names, default) in ARMS.items()}
    kinds = {"range": parse.reach, "attacks": parse.dice_text, "damage": parse.dice_text, "abilities": parse.abilities}
    at["range"] = F.when(profile["kind"].rlike("(?i)ranged"), at["range"]).otherwise("melee")
    return F.struct(profile["name"], *(kinds.get(k, parse.stat)(v).alias(k) for k, v in at.items()))


def _entries(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Entries of the catalogues with the file of each; unread: the text of one that can't be read. The parser by records, as the one by files ends at the first error in a file."""
    reader = spark.read.format("xml").option("rowTag", "selectionEntry").option("wildcardColName", "inner").option("useLegacyXMLParser", True).option("columnNameOfCorruptRecord", "unread")
    return reader.option("pathGlobFilter", pattern).schema(f"{_FIELDS}, unread string").load(path).withColumn("file", F.col("_metadata.file_path"))


def unread_entries(spark: SparkSession, path: str, pattern: str = "*.{cat,gst}") -> DataFrame:
    """file, entry of each entry that isn't XML (X9); the others of its file are read all the same."""
    return _entries(spark, path, pattern).filter("unread IS NOT NULL AND _id IS NULL").select("file", F.col("unread").alias("entry"))


def units(spark: SparkSession, path: str, pattern: str = "*.{cat,gst}") -> DataFrame:
    """Units and models of the catalogues in path: faction (the file's name), id, name, characteristics, points, weapons, abilities, saves, warnings.

    Characteristics and weapons come from all profiles in an entry, also from those of entries and groups in it, at any depth; abilities
    and saves from what is not in an entry within. Of weapons with equal names the first stays. Of a unit id the last file's counts.
    Entries without id or name, and those that aren't XML (unread_entries has them), give no rows; numbers that can't be read are 0.
    """
    found = _entries(spark, path, pattern)
    rows = found.filter(F.col("_type").isin("unit", "model") & (F.length("_id") > 0) & (F.length("_name") > 0))
    rows = rows.withColumn("text", F.array_join(F.coalesce("inner", F.array().cast("array<string>")), "\n")).withColumn("body", _own(F.col("text")))
    rows = rows.withColumns({"all": _profiles(F.col("text")), "own": _profiles(F.col("body"))})
    rows = rows.withColumns({"main": F.get(F.filter("all", lambda p: p["kind"].rlike(UNIT)), F.lit(0)), "arms": F.filter("all", lambda p: p["kind"].rlike(WEAPON) & (F.length(p["name"]) > 0))})
    rows = rows.withColumn("told", F.transform(F.filter("own", lambda p: F.lower(p["kind"]) == "abilities"), lambda p: F.struct(p["name"], _trait(p, ["Description"], "").alias("text"))))
    names = F.transform("arms", lambda p: p["name"])
    weapons = F.transform(F.filter("arms", lambda p, i: F.array_position(names, p["name"]) == i + 1), _weapon)
    points = F.floor(F.coalesce(F.get(F.filter("costs.cost", lambda c: F.lower(F.trim(c["_name"])) == "pts"), F.lit(0))["_value"], F.lit(0.0)) + 0.5)
    given = F.flatten(F.transform(F.filter("own", lambda p: F.lower(p["kind"]) == "invulnerable save"), lambda p: F.transform(p["traits"], lambda c: parse.stat(F.trim(c["value"])))))
    invuln = F.coalesce(F.get(F.filter(given, lambda x: x.between(2, 6)), F.lit(0)), *(parse.number(F.col("body"), p) for p in INVULNERABLE))
    painless = lambda text: [parse.number(text, p) for p in NO_PAIN]
    fnp = F.coalesce(_first(F.transform("told", lambda a: F.coalesce(*painless(a["text"])))), *painless(F.col("body")))
    out = rows.select(
        "file", F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1).alias("faction"), F.col("_id").alias("id"), F.col("_name").alias("name"),
        *(parse.stat(_trait(F.col("main"), names, default)).alias(c) for c, (names, default) in TRAITS.items()), points.alias("points"), weapons.alias("weapons"), F.col("told").alias("abilities"),
        invuln.alias("invuln"), fnp.alias("fnp"),
    )
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("file")))
    out = out.withColumn("__last", last).filter("__last = 1").drop("__last", "file")
    checks = [(F.col("toughness") == 0, "no toughness"), (F.col("save") == 0, "no save"), (F.size("weapons") == 0, "no weapons"), (F.exists("weapons", lambda w: w["strength"] == 0), "weapon without strength"), (F.exists("weapons", lambda w: w["attacks"] == "0"), "weapon without attacks")]
    return out.withColumn("warnings", F.filter(F.array(*(F.when(bad, name) for bad, name in checks)), lambda w: w.isNotNull()))
