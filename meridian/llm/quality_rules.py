"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Features are counts over the whole text. A rule compares 100 times one count with a
percentage of another, in whole numbers, and may apply from a number of words on.
Nothing is shuffled: each document is judged where it is read.

Repeated five-word windows are found inside a document by sorting its window hashes
(64 bits) with their positions and comparing neighbours.

Cases: null or blank texts have no words, fail the base rules and are not kept;
words are the matches of [^\\x20\\x09-\\x0D]+; lines are cut at \\n and count only with
a word; one row out for each row in, repeated rows too. Added columns that clash with
existing ones take their place; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Common function words of the four languages.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as at by this from or an are was not "
    "le la les de des du et un une en que qui est dans pour sur par au pas "
    "der die das und ist von zu den mit ein eine im nicht auf dem für des sich auch "
    "el los las del y por con una para se su al lo como más"
).split()


class Rule(NamedTuple):
    """Fails where 100 * count is over (or under) percent * base, for documents with at least from_words words."""

    name: str
    count: str
    base: str
    over: int | None = None
    under: int | None = None
    from_words: int = 0


BASE = (
    Rule("too_short", "n_words", "one", under=1000),
    Rule("repeats", "n_repeat_words", "n_words", over=20),
)
THRESHOLDS = (
    Rule("word_too_short", "word_chars", "n_words", under=200),
    Rule("word_too_long", "word_chars", "n_words", over=1200),
    Rule("symbols", "n_symbols", "n_words", over=50),
    Rule("no_letters", "n_letter_words", "n_words", under=70, from_words=50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", over=40),
    Rule("no_stop_words", "n_stop_words", "one", under=100, from_words=50),
)


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _repeated_words(words: Column, width: int) -> Column:
    """The number of words that lie in a window of the given width which occurs twice or more."""
    at = F.sequence(F.lit(0), F.size(words) - width)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    start = F.struct(F.lit(-width).alias("at"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct(i.alias("at"), (acc.n + F.least(F.lit(width), i - acc.at)).alias("n"))

    def again(w: Column) -> Column:
        # Neighbours of equal hash in the sorted array are occurrences of one window.
        same = F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

    def found(h: Column) -> Column:
        # Most documents repeat no window, which distinct hashes tell without a sort.
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        covered = _let(ordered, lambda w: F.aggregate(again(w), start, step, lambda acc: acc.n))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered)

    return F.when(F.size(words) >= width, _let(hashes, found)).otherwise(0)


def features(text: Column, width: int = 5) -> Column:
    """A struct of the counts that rules use."""
    text = F.coalesce(text, F.lit(""))

    def counted(t: Column, words: Column, lines: Column) -> Column:
        made = {
            "n_words": F.size(words),
            "word_chars": F.length(t) - _without(t, SPACES),
            "n_symbols": _without(t, SYMBOLS),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeated_words(words, width),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
            "n_letter_words": F.regexp_count(t, F.lit(r"\p{L}[^\x20\x09-\x0D]*+")),  # from a word's first letter to its end
        }
        return F.struct(*(x.cast("long").alias(name) for name, x in made.items()))

    words = F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " ", -1), lambda x: x != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(F.translate(x, SPACES, " " * len(SPACES)))) > 0)
    return _let(F.struct(text.alias("t"), words.alias("w"), lines.alias("l")), lambda x: counted(x.t, x.w, x.l))


def failed(counts: Column, rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a document's counts fail, as one expression."""
    tests = []
    for r in rules:
        base = F.lit(1) if r.base == "one" else counts[r.base]
        bad = F.lit(False)
        if r.over is not None:
            bad = bad | (100 * counts[r.count] > r.over * base)
        if r.under is not None:
            bad = bad | (100 * counts[r.count] < r.under * base)
        tests.append(F.when(bad & (counts.n_words >= r.from_words), F.lit(r.name)))
    return F.array_compact(F.array(*tests))


def verdict(text: Column, rules: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """A struct of counts (a struct), base_failed, failed_rules (names) and kept."""

    def judged(c: Column) -> Column:
        bad, names = F.size(failed(c, BASE)) > 0, failed(c, rules)
        return F.struct(c.alias("counts"), bad.alias("base_failed"), names.alias("failed_rules"), (~bad & (F.size(names) == 0)).alias("kept"))

    return _let(features(text), judged)


def with_quality(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, text_col: str = "text") -> DataFrame:
    """docs with the counts, base_failed, the failed rules' names, and kept."""
    out = docs.withColumn("__q", verdict(F.col(text_col), rules))
    return out.withColumns({c: F.col(f"__q.counts.{c}") for c in COUNTS} | {c: F.col(f"__q.{c}") for c in ("base_failed", "failed_rules", "kept")}).drop("__q")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_letter_words")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
f AS (
  SELECT row_no, doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d),
p AS (SELECT row_no, w, unnest(range(1, len(w) - 3)) AS i FROM f WHERE len(w) >= 5),
g AS (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS c FROM p),
r AS (SELECT row_no, count(DISTINCT i + k) AS n FROM (SELECT row_no, i, unnest(range(0, 5)) AS k FROM g WHERE c > 1) GROUP BY row_no),
a AS (
  SELECT doc_id, len(w) AS n_words, word_chars, n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}))) AS n_stop_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words
  FROM f LEFT JOIN r USING (row_no)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * word_chars < 200 * n_words OR 100 * word_chars > 1200 * n_words OR 100 * n_symbols > 50 * n_words
    OR (n_words >= 50 AND 100 * n_letter_words < 70 * n_words) OR 100 * n_dup_lines > 40 * n_lines OR (n_words >= 50 AND n_stop_words < 1)) AS kept
FROM b"""
