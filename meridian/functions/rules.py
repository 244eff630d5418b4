"""Rules in the descriptions of leaders, labels of abilities and a 32-bit hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions import parse

#: How descriptions tell a rule, in order; a number is the rule's own value, None takes it from the text.
LEADER = [
    ("REROLL_HITS_OF_1", r"(?i)re-?roll\s+(?:the\s+)?hit\s+rolls?\s+of\s+1", 0),
    ("REROLL_HITS", r"(?i)re-?roll\s+(?:all\s+)?(?:the\s+)?hit\s+rolls?", 0),
    ("REROLL_WOUNDS", r"(?i)re-?roll\s+(?:all\s+)?(?:the\s+)?wound\s+rolls?", 0),
    ("LETHAL_HITS", r"(?i)\blethal\s+hits\b", 0),
    ("SUSTAINED_HITS", r"(?i)\bsustained\s+hits\s+(\d+)\b", None),
    ("DEVASTATING_WOUNDS", r"(?i)\bdevastating\s+wounds\b", 0),
    ("HIT_MOD", r"(?i)(?:add\s+1|(?:\+\s*1))\s+to\s+(?:the\s+)?hit\s+rolls?", 1),
    ("WOUND_MOD", r"(?i)(?:add\s+1|(?:\+\s*1))\s+to\s+(?:the\s+)?wound\s+rolls?", 1),
    ("HIT_MOD", r"(?i)(?:subtract\s+1|(?:-\s*1))\s+to\s+(?:the\s+)?hit\s+rolls?", -1),
]
#: Labels of abilities; {} is the value, {+} the value with its sign, {k} the keyword.
LABELS = {
    "SUSTAINED_HITS": "Sustained Hits {}", "LETHAL_HITS": "Lethal Hits", "DEVASTATING_WOUNDS": "Devastating Wounds", "TORRENT": "Torrent", "TWIN_LINKED": "Twin-linked", "BLAST": "Blast",
    "REROLL_HITS_OF_1": "Re-roll hits of 1", "REROLL_HITS": "Re-roll all hits", "REROLL_WOUNDS": "Re-roll wounds", "HIT_MOD": "{+} to hit", "WOUND_MOD": "{+} to wound", "STRENGTH_MOD": "Str {+}",
    "ATTACKS_MOD": "Attacks {+}", "ANTI": "Anti-{k} {}+", "MELTA": "Melta {}", "IGNORES_COVER": "Ignores Cover",
}
#: The hash's start and factor.
START, FACTOR = 0x811C9DC5, 0x01000193


def told(text: Column) -> Column:
    """All rules that a description tells, each once: an array of (type, value). Null tells none."""
    found = (F.when(text.rlike(p), F.struct(F.lit(kind).alias("type"), (parse.number(text, p) if value is None else F.lit(value)).alias("value"))) for kind, p, value in LEADER)
    return F.array_distinct(F.array_compact(F.array(*found)))


def leader_rules(abilities: DataFrame) -> DataFrame:
    """abilities (unit, seq, name, text): unit, type, value and the first ability that gives the rule as source."""
    rows = abilities.select("unit", "seq", "name", F.explode(told(F.col("text"))).alias("rule"))
    return rows.groupBy("unit", F.col("rule.type").alias("type"), F.col("rule.value").alias("value")).agg(F.min_by("name", "seq").alias("source"))


def label(ability: Column) -> Column:
    """An ability (type, value, keyword) as readers see it; the type itself where it has no label."""
    kind, value = ability["type"], ability["value"].cast("string")
    signed = F.concat(F.when(ability["value"] > 0, "+").otherwise(""), value)
    filled = lambda x: F.replace(F.replace(F.replace(F.lit(x), F.lit("{+}"), signed), F.lit("{k}"), F.coalesce(ability["keyword"], F.lit(""))), F.lit("{}"), value)
    out = F.when((kind == "ATTACKS_MOD") & (ability["value"] == 0), "Extra Attacks")
    for k, x in LABELS.items():
        out = out.when(kind == k, filled(x) if "{" in x else x)
    return out.otherwise(kind)


def hash32(text: Column) -> Column:
    """Exclusive or with each UTF-16 unit, then a product in double precision, of which 32 bits stay; in hexadecimal. The product's rounding makes it another hash than FNV-1a."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0)), lambda u: F.conv(u, 16, 10).cast("long"))

    def step(h: Column, unit: Column) -> Column:
        x = h.bitwiseXOR(unit)
        signed = F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)
        return (signed.cast("double") * float(FACTOR)).cast("long").bitwiseAND(F.lit((1 << 32) - 1))

    return F.lower(F.hex(F.aggregate(units, F.lit(START).cast("long"), step)))
