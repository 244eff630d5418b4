"""Names and markup, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridian.functions.white import trimmed

#: Tags and entities with what stands for them in plain text and in Markdown, in order.
PLAIN = [
    (r"(?i)<br\s*/?>", "\n"), (r"(?i)</?(?:p|div)\b[^>]*>", "\n"), (r"(?i)</li>", ""), (r"(?i)<li[^>]*>", "\n• "), (r"(?i)</tr>", "\n"), (r"(?i)<hr[^>]*>", "\n---\n"), (r"<[^>]*>", ""),
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"),
    (r"[ \t]+", " "), (r"\n ", "\n"), (r" \n", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
]
MARKDOWN = [
    (r"(?i)<br\s*/?>", "\n"), (r"(?i)<b>([^\n]*?)</b>", "**{1}**"), (r"(?i)<(?:i|em)>([^\n]*?)</(?:i|em)>", "*{1}*"), (r'(?i)<span[^>]*class="kwb"[^>]*>([^\n]*?)</span>', "**{1}**"), (r"(?i)<span[^>]*>([^\n]*?)</span>", "{1}"),
    (r"(?i)</(?:p|div)>", "\n"), (r"(?i)<(?:p|div)[^>]*>", ""), (r"(?i)<li[^>]*>", "- "), (r"(?i)</li>", "\n"), (r"(?i)</?(?:ul|ol)[^>]*>", "\n"),
    (r"(?i)</(?:td|th)>", " "), (r"(?i)</tr>", "\n"), (r"<[^>]+>", ""),
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
]
#: How army lists name their detachment, and what faction names may be wrapped in.
DETACHMENT = [r"(?im)^\+?\s*DETACHMENT:\s*(.+)$", r"(?im)^--\s*(.+?)\s*Detachment\s*--$"]
FACTION_WRAPS = [(r"^Imperium\s+", ""), (r"^Chaos\s+", ""), (r"^Aeldari\s+", ""), (r"^Library\s+", ""), (r"\s+Library$", "")]


def replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    """One replacement after the other; {1} stands for the first group, {2} for the second.

    A pattern of a tag is looked for before the last mark that can end it: there every opening one finds an end, so that no text is
    read again from each opening mark without one. The end of a pair has to be in the line, and so lines are gone through one by one.
    """

    def step(x: Column, s: tuple[str, str]) -> Column:
        to = re.sub(r"\{(\d)\}", r"$\1", s[1])
        pair = PAIR.search(s[0])
        if not pair and "[^>]" not in s[0]:
            return F.regexp_replace(x, s[0], to)
        some = lambda v: _up_to_last(v, pair[1] if pair else ">", s[0], to)
        if pair and "[^>]" not in s[0]:
            return F.array_join(F.transform(F.split(x, "\n", -1), some), "\n")
        return F.get(F.transform(F.array(x), some), 0)  # names x, which is used several times

    return reduce(step, steps, text)


PAIR = re.compile(r"\(\[\^\\n\]\*\?\)(.+)$")


def _up_to_last(text: Column, closing: str, pattern: str, to: str) -> Column:
    head = F.regexp_extract(text, f"(?is)^.*{closing}", 0)
    return F.when(~text.rlike(f"(?i){closing}"), text).otherwise(F.concat(F.regexp_replace(head, pattern, to), F.substring(text, F.length(head) + 1, F.length(text))))


def replaced_sql(text: str, steps: list[tuple[str, str]]) -> str:
    """The same for DuckDB."""
    quoted = lambda x: x.replace("'", "''")
    return reduce(lambda x, s: f"regexp_replace({x}, '{quoted(s[0])}', '{quoted(s[1].replace('{1}', chr(92) + '1'))}', 'g')", steps, text)


def html_to_text(html: Column) -> Column:
    return F.coalesce(replaced(html, PLAIN), F.lit(""))


def html_to_markdown(html: Column) -> Column:
    """Text without a tag stays as it is."""
    return F.when(html.contains("<"), replaced(html, MARKDOWN)).otherwise(html)


def detachment(text: Column) -> Column:
    """The first pattern that gives a name; null without one."""
    return F.coalesce(*(F.nullif(trimmed(F.regexp_extract(text, p, 1)), F.lit("")) for p in DETACHMENT))


def faction(name: Column) -> Column:
    return trimmed(replaced(name, FACTION_WRAPS))


def faction_prefix(name: Column) -> Column:
    """A faction's name without the alliance and dash before it."""
    return F.regexp_replace(name, r"^(Imperium|Chaos)\s*-\s*", "")


def unit_name(name: Column) -> Column:
    """Lower case, one kind of quote, marks and accented letters left out, single spaces."""
    plain = F.translate(F.lower(name), "‘’′`", "''''")
    return trimmed(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9_\s'-]", ""), r"\s+", " "))


def title(name: Column) -> Column:
    """A capital at the start and after any white space, small letters elsewhere."""
    words = F.split(F.lower(F.translate(name, "‘’′", "'''")), r"(?<=\s)")
    return trimmed(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), ""))


def base_name(name: Column) -> Column:
    """A name without what follows in brackets; dashes between words as spaces."""
    return trimmed(F.regexp_replace(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""), " - ", " "))


def notes(*parts: Column) -> Column:
    return F.concat_ws(" | ", *(F.nullif(p, F.lit("")) for p in parts))
