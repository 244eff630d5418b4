"""WARC derivatives: a linked metadata record and a plain-text conversion record for each response.

Both refer to the response by WARC-Refers-To and keep its target URI, date and payload
digest. The metadata record holds the source's status, HTTP headers, title and links as
WARC fields; the conversion record holds the page's text. Record ids are made from the
response's id, so that a second run gives the same records. Digests are SHA-256 in
hexadecimal, with the algorithm as label.

All of it is one projection of Spark expressions: nothing is shuffled, and a task lost
with an executor is run again. Text comes from HTML by removing comments, scripts and
styles (an unclosed one reaches to the end), turning block tags into line ends, dropping
other tags, decoding numeric references and the named ones of HTML 4, and closing up white
space. Attributes count in double or single quotes or without any, and a tag ends at
the next ">" or with the page; titles and links are decoded too. Each pattern goes over a
page once: titles are cut out by their first marks, and attributes are looked for in one
tag at a time (the language in the first html tag), so that a page of marks that nothing closes takes no longer than another.

Cases: a null payload counts as empty and gives both records with empty text; a null URI
leaves out that header; a null id gives records made from the empty id; repeated rows
give repeated records; other columns pass unchanged, and added columns take the place of
existing ones with their names.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Tags that end a line.
BLOCKS = "address article aside blockquote body br dd div dl dt footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td th thead title tr ul".split()
ENTITIES = {name: " " if name == "nbsp" else chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}
REFERENCE = "^(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[a-zA-Z][a-zA-Z0-9]{1,31});"
TAG, ATTRIBUTE = r"(?i)<%s\b[^>]*>", r"""(?i)^<%s\b(?:[^>]*?[ \t\r\n\f"'])?%s[ \t\r\n\f]*=[ \t\r\n\f]*("[^"\r\n]*"|'[^'\r\n]*'|[^ \t\r\n\f"'=<>]+)"""
TITLE = r"(?i)<title\b", r"(?i)</title"
QUOTES = "^[\"']|[\"']$"
GONE = r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z))"
BREAKS = rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*(?:>|\z)"
TAGS = r"<[a-zA-Z/!?][^>]*(?:>|\z)"
WHITE = r"[ \t\r\f\x0B\xA0]{2,}|[\t\r\f\x0B\xA0]"  # a single space stays as it is
DATE = "2024-01-01T00:00:00Z"


def _decoded(text: Column) -> Column:
    """Character references as characters, each decoded once; unknown names stay, and impossible code points become U+FFFD."""
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def char(ref: Column) -> Column:
        digits = F.regexp_replace(ref, "^#[xX]?", "")
        code = F.when(ref.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        high = F.lpad(F.hex(F.lit(0xD800) + F.floor((code - 0x10000) / 1024).cast("int")), 4, "0")
        low = F.lpad(F.hex(F.lit(0xDC00) + (code - 0x10000) % 1024), 4, "0")
        units = F.when(code >= 0x10000, F.concat(high, low)).otherwise(F.lpad(F.hex(code), 4, "0"))
        bad = (code < 1) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        numeric = F.when(bad, F.lit("\ufffd")).otherwise(F.decode(F.unhex(F.when(~bad, units)), "UTF-16BE"))
        return F.when(ref == "", F.lit(None)).when(ref.startswith("#"), numeric).otherwise(F.try_element_at(names, ref))

    def one(part: Column, i: Column) -> Column:
        ref = F.regexp_extract(part, REFERENCE, 1)
        tail = F.substring(part, F.length(ref) + 2, F.length(part))
        return F.when(i == 0, part).otherwise(F.coalesce(F.concat(char(ref), tail), F.concat(F.lit("&"), part)))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&", -1), one), "")).otherwise(text)


def attributes(html: Column, tag: str, name: str) -> Column:
    """The values, in their quotes, of an attribute in each tag of a kind that has it."""
    tags = F.regexp_extract_all(F.concat(html, F.lit(">")), F.lit(TAG % tag), 0)
    return F.filter(F.transform(tags, lambda x: F.regexp_extract(x, ATTRIBUTE % (tag, name), 1)), lambda x: x != "")


def with_title(rows: DataFrame, html: str, name: str = "title") -> DataFrame:
    """rows with what stands between the first title tag of a page and the next end of one; empty without both.

    Each step is a column, so that none is computed again where the next one uses it twice.
    """
    at = F.regexp_instr(F.col(html), F.lit(TITLE[0]))
    rows = rows.withColumn("__from", F.when(at > 0, F.substring(F.col(html), at, F.length(html))).otherwise(""))
    rows = rows.withColumn("__behind", F.when(F.instr("__from", ">") > 0, F.substring("__from", F.instr("__from", ">") + 1, F.length("__from"))).otherwise(""))
    rows = rows.withColumn("__end", F.regexp_instr("__behind", F.lit(TITLE[1])))
    return rows.withColumn(name, F.when(F.col("__end") > 1, F.substring("__behind", F.lit(1), F.col("__end") - 1)).otherwise("")).drop("__from", "__behind", "__end")


def text_of(html: Column) -> Column:
    """The text of an HTML page, lines between blocks."""
    return _text(F.regexp_replace(html, GONE, " "))


def _text(clean: Column) -> Column:
    """The text of a page without comments, scripts and styles."""
    out = F.regexp_replace(F.regexp_replace(clean, BREAKS, "\n"), TAGS, "")
    out = F.regexp_replace(F.regexp_replace(_decoded(out), WHITE, " "), r" ?\n[ \n]*", "\n")
    return F.btrim(out, F.lit(" \n"))


def _line(text: Column) -> Column:
    """A field's value: white space that could end its line becomes a space."""
    return F.regexp_replace(text, r"[ \t\r\n]+", " ")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """pages as response records: record_id, target_uri, date, http_header and payload are added."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    header = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF))
    made = {"record_id": _uuid(F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))), "target_uri": F.col(url_col), "date": F.lit(date), "http_header": header, "payload": payload.cast("binary")}
    return pages.withColumns(made)


def derive(found: DataFrame) -> DataFrame:
    """Two records for each response: its other columns, and warc_type, record_id, refers_to, target_uri, date, content_type, source_digest, block, block_digest, content_length and record.

    found: record_id, target_uri, date, http_header (string, lines ended by CR LF) and payload (binary).
    """
    own = ("record_id", "target_uri", "date", "http_header", "payload")
    rest = [F.col(f"`{c}`") for c in found.columns if c not in own and c not in ADDED]
    html = F.make_valid_utf8(F.coalesce(F.col("payload"), F.lit(b"")).cast("string"))
    rows = found.select(*rest, F.col("record_id").alias("refers_to"), "target_uri", "date", F.coalesce("http_header", F.lit("")).alias("__head"), html.alias("__html"), _digest(F.coalesce(F.col("payload"), F.lit(b""))).alias("source_digest"))
    rows = with_title(rows.withColumn("__clean", F.regexp_replace("__html", GONE, " ")), "__html", "__title")
    rows = rows.withColumns({"__tag": F.regexp_extract(F.concat("__html", F.lit(">")), TAG % "html", 0), "__hrefs": attributes(F.col("__clean"), "a", "href")})
    rows = rows.withColumn("__lang", F.regexp_extract("__tag", ATTRIBUTE % ("html", "lang"), 1))
    bare = lambda x: _line(_decoded(F.regexp_replace(x, QUOTES, "")))
    links = F.transform("__hrefs", lambda x: F.concat(F.lit("outlink: "), bare(x), F.lit(CRLF)))
    title = F.trim(_line(_decoded(F.col("__title"))))
    lang = bare(F.col("__lang"))
    fields = F.concat(
        F.lit("source-status: "), F.regexp_extract("__head", r"^HTTP/[0-9.]+ ([0-9]{3})", 1), F.lit(CRLF),
        F.regexp_replace(F.regexp_replace("__head", r"^HTTP/[^\r]*\r\n", ""), r"([^\r\n]+)\r\n", "source-header: $1\r\n"),
        F.lit("source-payload-digest: "), F.col("source_digest"), F.lit(CRLF), F.lit("title: "), title, F.lit(CRLF), F.lit("language: "), lang, F.lit(CRLF), F.array_join(links, ""),
    )

    def record(kind: str, content: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("warc_type"), F.lit(content).alias("content_type"), block.alias("block"))

    both = F.array(record("metadata", "application/warc-fields", fields), record("conversion", "text/plain; charset=UTF-8", _text(F.col("__clean"))))
    rows = rows.withColumn("__r", F.explode(both)).select(*rest, "refers_to", "target_uri", "date", "source_digest", "__r.*")
    rows = rows.withColumns({"record_id": _uuid(F.col("warc_type"), F.coalesce("refers_to", F.lit(""))), "block_digest": _digest(F.col("block")), "content_length": F.octet_length("block").cast("long")})
    return rows.withColumn("record", serialised()).select(*rest, *ADDED)


ADDED = ("warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_digest", "block", "block_digest", "content_length", "record")


def serialised() -> Column:
    """A derived record as WARC/1.1."""
    head = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Source-Payload-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(CRLF)), F.lit("")) for name, c in head]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *lines, F.lit(CRLF), F.col("block"), F.lit(CRLF * 2))


def parse(records: DataFrame, record_col: str = "record") -> DataFrame:
    """records with headers (map of lower-case name to value) and block read from their serialised form."""
    cut = F.instr(F.col(record_col), CRLF * 2)
    lines = F.filter(F.split(F.substring(F.col(record_col), F.lit(1), cut - 1), CRLF), lambda x: F.contains(x, F.lit(": ")))
    headers = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.lower(F.substring_index(x, ": ", 1)), F.substring(x, F.instr(x, ": ") + 2, F.length(x)))))
    whole = F.substring(F.col(record_col), cut + 4, F.length(record_col))
    return records.withColumns({"headers": headers, "block": F.substring(whole, F.lit(1), F.length(whole) - 4)})


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    names = f"MAP {{{', '.join(f'{q(k)}: {q(v)}' for k, v in ENTITIES.items())}}}"
    code = "CAST(CASE WHEN lower(substr(z.r, 2, 1)) = 'x' THEN '0x' || substr(z.r, 3) ELSE substr(z.r, 2) END AS INTEGER)"
    char = f"CASE WHEN z.r = '' THEN NULL WHEN z.r[1] = '#' THEN CASE WHEN {code} < 1 OR {code} BETWEEN 55296 AND 57343 OR {code} > 1114111 THEN '\ufffd' ELSE chr({code}) END ELSE m[z.r] END"
    part = lambda t: f"list_transform(string_split({t}, '&'), lambda x, i: {{'x': x, 'i': i, 'r': regexp_extract(x, {q(REFERENCE)}, 1)}})"
    decoded = lambda t: f"array_to_string(list_transform({part(t)}, lambda z: CASE WHEN z.i = 1 THEN z.x ELSE coalesce({char} || substr(z.x, length(z.r) + 2), '&' || z.x) END), '')"
    line = lambda t: f"regexp_replace({t}, '[ \\t\\r\\n]+', ' ', 'g')"
    bare = lambda t: line(decoded(f"regexp_replace({t}, {q(QUOTES)}, '', 'g')"))
    plain = f"regexp_replace(regexp_replace(regexp_replace(html, {q(GONE)}, ' ', 'g'), {q(BREAKS)}, chr(10), 'g'), {q(TAGS)}, '', 'g')"
    text = f"trim(regexp_replace(regexp_replace(regexp_replace({decoded(plain)}, '[ \\t\\r\\f\\x0B\\xA0]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '^\\n|\\n\\z', '', 'g'), ' ')"
    values = lambda t, tag, name: f"list_filter(list_transform(regexp_extract_all({t} || '>', {q(TAG % tag)}), lambda x: regexp_extract(x, {q(ATTRIBUTE % (tag, name))}, 1)), lambda x: x <> '')"
    uuid = lambda h: f"'<urn:uuid:' || substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12) || '>'"
    return f"""
WITH names AS (SELECT {names} AS m), p AS (SELECT page_id, url, coalesce(html, '') AS html, chr(13) || chr(10) AS e, m FROM pages, names),
t AS (SELECT *, {text} AS body, md5('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')) AS h, 'sha256:' || sha256(html) AS source_digest,
  list_transform({values(f"regexp_replace(html, {q(GONE)}, ' ', 'g')", "a", "href")}, lambda y: 'outlink: ' || {bare("y")} || chr(13) || chr(10)) AS links,
  trim({line(decoded("regexp_extract(html, '(?is)<title" + chr(92) + "b[^>]*>(.*?)</title', 1)"))}, ' ') AS title,
  {bare(f"regexp_extract(regexp_extract(html || '>', {q(TAG % 'html')}), {q(ATTRIBUTE % ('html', 'lang'))}, 1)")} AS lang FROM p),
m AS (SELECT page_id, url, {uuid("h")} AS refers_to, source_digest, e,
    unnest(['metadata', 'conversion']) AS warc_type, unnest(['application/warc-fields', 'text/plain; charset=UTF-8']) AS content_type,
    unnest(['source-status: 200' || e || 'source-header: Content-Type: text/html; charset=UTF-8' || e || 'source-header: Content-Length: ' || strlen(html) || e
      || 'source-payload-digest: ' || source_digest || e || 'title: ' || title || e || 'language: ' || lang || e || coalesce(array_to_string(links, ''), ''), body]) AS block FROM t),
r AS (SELECT *, md5(warc_type || '|' || refers_to) AS h2, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length FROM m),
f AS (SELECT *, {uuid("h2")} AS record_id FROM r)
SELECT page_id, warc_type, record_id, refers_to, url AS target_uri, content_type, source_digest, block, block_digest, content_length,
  sha256('WARC/1.1' || e || 'WARC-Type: ' || warc_type || e || 'WARC-Record-ID: ' || record_id || e || 'WARC-Refers-To: ' || refers_to || e
    || coalesce('WARC-Target-URI: ' || url || e, '') || 'WARC-Date: {DATE}' || e || 'WARC-Source-Payload-Digest: ' || source_digest || e
    || 'WARC-Block-Digest: ' || block_digest || e || 'Content-Type: ' || content_type || e || 'Content-Length: ' || content_length || e || e || block || e || e) AS record_sha256 FROM f"""


SQL = _sql()
