"""Markdown to HTML and JSON laid out for reading (S11, SNK12)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from meridian.functions.text import replaced
from meridian.functions.white import trimmed

HEADING, ITEM = r"^(#{1,3})\s+(.+)", r"^[-*]\s+(.+)"
#: The HTML that pages are styled for.
LIST, PARAGRAPH = '<ul class="list-disc list-inside space-y-0.5 text-slate-300 text-sm">', '<p class="text-slate-300 text-sm">'
SIZES = ["text-lg font-bold", "text-base font-semibold", "text-sm font-semibold"]
INLINE = [
    ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), (r"\[([^\]]+)\]\(([^)]+)\)", '<a href="{2}" class="text-amber-400 underline hover:text-amber-300" target="_blank" rel="noopener noreferrer">{1}</a>'),
    (r"\*\*([^*]+)\*\*", '<strong class="font-semibold text-slate-100">{1}</strong>'), (r"\*([^*]+)\*", "<em>{1}</em>"), ("`([^`]+)`", '<code class="px-1 py-0.5 rounded bg-slate-800 text-amber-300 text-xs font-mono">{1}</code>'),
]


def markdown_to_html(text: Column) -> Column:
    """Headings of three levels, lists, paragraphs and inline marks; a blank line is a break. Null stays null.

    A line is in a list where it is an item, so only its neighbour tells whether a list begins or ends; no state runs along the lines.
    """
    inline = lambda x: replaced(x, INLINE)
    is_item = lambda x: ~x.rlike(HEADING) & x.rlike(ITEM)
    around = lambda name, attributes, x: F.concat(F.lit(f"<{name}{attributes}>"), x, F.lit(f"</{name}>"))

    def shown(x: Column) -> Column:
        level = F.length(F.regexp_extract(x, HEADING, 1))
        out = F.when(is_item(x), around("li", "", inline(F.regexp_extract(x, ITEM, 1))))
        for k, size in enumerate(SIZES, 1):
            out = out.when(level == k, around(f"h{k}", f' class="{size} text-slate-200 mt-3 mb-1"', inline(F.regexp_extract(x, HEADING, 2))))
        return out.when(trimmed(x) == "", "<br/>").otherwise(F.concat(F.lit(PARAGRAPH), inline(x), F.lit("</p>")))

    lines = F.split(text, "\n")
    rows = F.zip_with(lines, F.concat(F.array(F.lit("")), F.slice(lines, 1, F.size(lines) - 1)), lambda x, before: F.struct(is_item(x).alias("item"), is_item(before).alias("before"), shown(x).alias("html")))
    opened = F.transform(rows, lambda r: F.concat(F.when(r["item"] & ~r["before"], LIST + "\n").when(~r["item"] & r["before"], "</ul>\n").otherwise(""), r["html"]))
    return F.concat(F.array_join(opened, "\n"), F.when(is_item(F.element_at(lines, -1)), "\n</ul>").otherwise(""))


def _number(text: str) -> int | float:
    x = float(text)
    return int(x) if x.is_integer() and abs(x) < 1e21 else x


def _no_constant(text: str):
    raise ValueError(text)


def _laid_out(text: str | None) -> str | None:
    try:
        return json.dumps(json.loads(text, parse_int=_number, parse_float=_number, parse_constant=_no_constant), indent=2, ensure_ascii=False)
    except (TypeError, ValueError, RecursionError):
        return text


@F.pandas_udf(StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    """JSON over several lines, keys in their order; text that is no JSON stays as it is. Numbers are doubles; Spark's functions need a schema, and sort keys without one."""
    return text.map(_laid_out)
