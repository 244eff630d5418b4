"""Numbers, dice and abilities out of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How weapon abilities are written, in order of precedence; a number is the ability's own value, None takes it from the text.
ABILITIES = [
    ("SUSTAINED_HITS", r"(?i)sustained hits\s*\(?(\d+)\)?", None),
    ("LETHAL_HITS", r"(?i)lethal hits", 0),
    ("DEVASTATING_WOUNDS", r"(?i)devastating wounds", 0),
    ("TORRENT", r"(?i)torrent", 0),
    ("TWIN_LINKED", r"(?i)twin.linked", 0),
    ("BLAST", r"(?i)blast", 0),
    ("REROLL_HITS_OF_1", r"(?i)re-?roll\s+(?:all\s+)?hit\s+rolls?\s+of\s+1", 0),
    ("REROLL_HITS", r"(?i)re-?roll\s+(?:all\s+)?hit\s+rolls?(?!\s+of)", 0),
    ("REROLL_WOUNDS", r"(?i)re-?roll\s+(?:all\s+)?wound\s+rolls?", 0),
    ("HIT_MOD", r"(?i)heavy", 1),
    ("ATTACKS_MOD", r"(?i)rapid fire\s*\(?(\d+)\)?", None),
    ("ATTACKS_MOD", r"(?i)extra attacks", 0),
    ("WOUND_MOD", r"(?i)lance", 1),
    ("ANTI", r"(?i)anti-.+?\s*\(?(\d)\+\)?", None),
    ("MELTA", r"(?i)melta\s*\(?(\d+)\)?", None),
    ("IGNORES_COVER", r"(?i)ignores cover", 0),
    ("HAZARDOUS", r"(?i)hazardous", 0),
    ("PRECISION", r"(?i)precision", 0),
    ("INDIRECT_FIRE", r"(?i)indirect fire", 0),
    ("ASSAULT", r"(?i)\bassault\b", 0),
    ("PISTOL", r"(?i)\bpistol\b", 0),
    ("ONE_SHOT", r"(?i)one shot", 0),
    ("PSYCHIC", r"(?i)psychic", 0),
]
ANTI_KEYWORD = r"(?i)anti-(.+?)\s*\(?\d\+"
ABILITY_TYPE = "struct<type:string,value:int,keyword:string>"


def number(text: Column, pattern: str) -> Column:
    """The first match's first group as an integer; null without a match or beyond the type."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")


def leading_int(text: Column) -> Column:
    """The integer a text begins with; null without one."""
    return number(text, r"^\s*([+-]?\d+)")


def stat(text: Column) -> Column:
    """A profile's number: plus signs at the end and inch marks aside; 0 without one."""
    return F.coalesce(leading_int(F.trim(F.translate(F.regexp_replace(text, r"\+$", ""), "\"'″′“”‘’", ""))), F.lit(0))


def dice_text(text: Column) -> Column:
    """Dice notation without spaces and in capitals; a blank or a dash stands for 1."""
    x = F.upper(F.regexp_replace(text, r"\s+", ""))
    return F.when(x.isin("", "-", "–"), "1").otherwise(x)


def reach(text: Column) -> Column:
    """A weapon's range in inches, or 'melee'."""
    return F.when(F.lower(F.trim(text)).isin("melee", "-", ""), "melee").otherwise(stat(text).cast("string"))


def points(text: Column) -> Column:
    """'95 pts' or a leading number; 0 without either."""
    return F.coalesce(number(text, r"(?i)(\d+)\s*pts?"), leading_int(text), F.lit(0))


def models(text: Column) -> Column:
    """'5 models' or a number before a space; null without either."""
    return F.coalesce(number(text, r"(?i)(\d+)\s*model"), number(text, r"^(\d+)\s"))


def dice(text: Column) -> Column:
    """Notation like 2D6+1 or a plain number as (count, sides, plus); other text has no dice and adds 0."""
    rolls = text.rlike(r"(?i)^\d*D\d+([+-]\d+)?$")
    part = lambda pattern, default: F.coalesce(number(text, pattern), F.lit(default))
    plain = F.coalesce(number(text, r"^(\d+)$"), F.lit(0))
    return F.struct(
        F.when(rolls, part(r"^(\d+)[dD]", 1)).otherwise(0).alias("count"), F.when(rolls, part(r"[dD](\d+)", 0)).otherwise(0).alias("sides"), F.when(rolls, part(r"([+-]\d+)$", 0)).otherwise(plain).alias("plus"),
    )


def dice_mean(d: Column) -> Column:
    return d["count"] * (1 + d["sides"]) / 2 + d["plus"]


def dice_least(d: Column) -> Column:
    """Dice count as one each, at least 1 in all; a plain number is itself."""
    return F.when(d["count"] > 0, F.greatest(F.lit(1), d["count"] + d["plus"])).otherwise(d["plus"])


def dice_most(d: Column) -> Column:
    return d["count"] * d["sides"] + d["plus"]


def abilities(text: Column) -> Column:
    """The known abilities of a list like 'Lethal Hits, [BLAST]', each (type, value, keyword); unknown ones are left out."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[,;—–]"), lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r"^\[(.+)\]$", "$1"), r"\.+$", ""))

    def known(p: Column) -> Column:
        value = lambda pattern, own: number(p, pattern) if own is None else F.lit(own)
        keyword = lambda kind: F.regexp_extract(p, ANTI_KEYWORD, 1) if kind == "ANTI" else F.lit(None).cast("string")
        return F.coalesce(*(F.when(p.rlike(pattern), F.struct(F.lit(kind).alias("type"), value(pattern, own).alias("value"), keyword(kind).alias("keyword"))) for kind, pattern, own in ABILITIES))

    return F.filter(F.transform(parts, known), lambda a: a.isNotNull())
