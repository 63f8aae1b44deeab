"""Derived WARC records: for every response a metadata and a conversion record that refer to it.

One pass over the responses and no shuffle; all but the decoding of character references are built-in functions.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What has no text; tags that end a line; other tags; white space. Plain enough for other engines' dialects.
DROPPED = r"(?is)<!--.*?-->|<script.*?</script[^>]*>|<style.*?</style[^>]*>"
BREAKS = r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|br|tr|td|table|article|nav|section|header|footer|title|head|body|html)(?:[\s/][^>]*)?>"
TAGS = r"<[^>]*>"
BLANKS = r"[ \t\r\f\x0B]+"
LINES = r" ?\n[ \n]*"
#: Named (with or without their semicolon), decimal and hexadecimal references, as HTML 5 reads them.
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LANGUAGE = r"(?i)<html[^>]*\slang=\"([^\"]*)\""
LINKS = r"(?i)<a\s[^>]*href="


def decoded(text: str) -> str:
    """Text with every HTML 5 character reference decoded once; a referred no-break space is a space."""
    return REFERENCE.sub(lambda m: markup.unescape(m.group()).replace("\xa0", " "), text) if "&" in text else text


@F.pandas_udf(StringType())
def _decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(decoded, na_action="ignore")


def plain_text(html: Column) -> Column:
    """Text of an HTML page: lines at block tags, single spaces, character references decoded."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, DROPPED, ""), BREAKS, "\n"), TAGS, "")
    text = _decoded(text)
    return F.btrim(F.regexp_replace(F.regexp_replace(text, BLANKS, " "), LINES, "\n"), F.lit(" \n"))


def _record_id(kind: str, *parts: Column) -> Column:
    """A name-based record id: the same response always gives the same ids."""
    h = F.md5(F.concat_ws("\n", F.lit(kind), *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def derive(responses: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", headers: str | None = None, record_id: str | None = None, date: str | None = None) -> DataFrame:
    """Two records a capture: key, warc_type, record_id, refers_to, target_uri, refers_to_date, content_type,
    source_headers, source_payload_digest, block, block_digest, content_length (bytes of the block).

    ``headers``, ``record_id``, ``date``: columns of the source record, kept as they are; without
    them the headers are made from the page, the source's id from its key, address, date and payload
    digest, and the date is null. The derived records' ids follow from the source's id. Null pages
    and addresses count as empty, null keys are kept, other columns are ignored and an empty table
    gives no rows. Rows equal in all of these are one capture and repeat its records.
    """
    page = F.coalesce(F.col(html), F.lit(""))
    address = F.coalesce(F.col(url), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    own = F.concat(F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(page).cast("string"))
    when = F.col(date).cast("string") if date else F.lit(None).cast("string")
    made = _record_id("response", name, address, F.coalesce(when, F.lit("")), _digest(page))
    source = responses.select(
        F.col(key).alias(key), address.alias("target_uri"), page.alias("_page"),
        (F.coalesce(F.col(headers), F.lit("")) if headers else own).alias("source_headers"),
        (F.coalesce(F.col(record_id), made) if record_id else made).alias("refers_to"), when.alias("refers_to_date"), _digest(page).alias("source_payload_digest"),
    )
    text = plain_text(F.col("_page"))
    title = F.btrim(F.regexp_replace(F.regexp_extract("_page", TITLE, 1), r"\s+", " "), F.lit(" "))
    fields = F.concat_ws(
        "\r\n", F.concat(F.lit("title: "), title), F.concat(F.lit("language: "), F.regexp_extract("_page", LANGUAGE, 1)),
        F.concat(F.lit("outlinks: "), F.regexp_count("_page", F.lit(LINKS)).cast("string")), F.concat(F.lit("source-payload-digest: "), F.col("source_payload_digest")), F.col("source_headers"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain").alias("content_type"), text.alias("block")),
    )
    each = source.withColumn("_r", F.explode(kinds)).select("*", "_r.*")
    return each.select(
        key, "warc_type", F.when(F.col("warc_type") == "metadata", _record_id("metadata", F.col("refers_to"))).otherwise(_record_id("conversion", F.col("refers_to"))).alias("record_id"),
        "refers_to", "target_uri", "refers_to_date", "content_type", "source_headers", "source_payload_digest", "block", _digest(F.col("block")).alias("block_digest"), F.octet_length("block").cast("long").alias("content_length"),
    )


def serialised(records: DataFrame, date: str) -> DataFrame:
    """record_id and ``warc`` (text of the whole record, format 1.1) of derived records; ``date``: when they were derived.

    Both kinds carry the source's headers, each named X-Source-..., and its payload digest.
    """
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    c = F.col
    lines = F.filter(F.split("source_headers", "\r?\n"), lambda h: F.contains(h, F.lit(":")))
    source = F.array_join(F.transform(lines, lambda h: F.concat(F.lit("X-Source-"), h, F.lit("\r\n"))), "")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", c("warc_type")), line("WARC-Record-ID", c("record_id")), line("WARC-Date", F.lit(date)), line("WARC-Refers-To", c("refers_to")),
        line("WARC-Refers-To-Target-URI", c("target_uri")), line("WARC-Refers-To-Date", c("refers_to_date")), line("WARC-Target-URI", c("target_uri")),
        line("X-Source-Payload-Digest", c("source_payload_digest")), source,
        line("WARC-Block-Digest", c("block_digest")), line("Content-Type", c("content_type")), line("Content-Length", c("content_length").cast("string")),
    )
    return records.select("record_id", F.concat(head, F.lit("\r\n"), c("block"), F.lit("\r\n\r\n")).alias("warc"))


def write(records: DataFrame, path: str, date: str) -> None:
    """Records as WARC files under ``path``, one for each task.

    A file is one gzip member: the text sink compresses files, and Spark has no sink for bytes; readers that seek by member read a file from its start.
    """
    serialised(records, date).select("warc").write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _sql_id(kind: str, *parts: str) -> str:
    h = f"md5('{kind}'" + "".join(f" || chr(10) || {p}" for p in parts) + ")"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {i}, {n})" for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_decoded(text: str) -> str:
    """Every character reference of ``text`` decoded once, by a table of all names."""
    names = markup.entities.html5
    table = f"MAP([{', '.join(_quoted('&' + n) for n in names)}], [{', '.join(_quoted(c) for c in names.values())}])"
    short = "|".join(sorted((n for n in names if not n.endswith(";")), key=len, reverse=True))
    low, high = "TRY_CAST(regexp_extract(t, '^&#([0-9]+)', 1) AS UBIGINT)", "TRY_CAST('0x' || regexp_extract(t, '^&#[xX]([0-9a-fA-F]+)', 1) AS UBIGINT)"
    number = f"coalesce({low}, {high})"
    wide = "".join(f" WHEN {c} THEN {_quoted(markup.unescape(f'&#{c};'))}" for c in range(0x80, 0xA0))
    one = f"CASE WHEN {number} = 0 OR {number} BETWEEN 55296 AND 57343 OR {number} > 1114111 THEN chr(65533) WHEN {number} BETWEEN 128 AND 159 THEN CASE {number}{wide} END ELSE chr(CAST({number} AS INT)) END"
    begin = f"regexp_extract(t, '^&(?:{short})')"
    named = f"coalesce(names[t], CASE WHEN {begin} <> '' THEN names[{begin}] || substr(t, length({begin}) + 1) ELSE t END)"
    each = f"list_transform(found, lambda t: CASE WHEN t LIKE '&#%' THEN {one} ELSE {named} END)"
    pieces = f"(SELECT array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(replace(decoded[i], chr(160), ' '), '')), '') FROM (SELECT parts, {each} AS decoded FROM (SELECT regexp_split_to_array(x, {_quoted(REFERENCE.pattern)}) AS parts, regexp_extract_all(x, {_quoted(REFERENCE.pattern)}) AS found, {table} AS names FROM (SELECT {text} AS x))))"
    return pieces


def oracle() -> str:
    """DuckDB SQL for ``derive`` over pages."""
    q = _quoted
    text = f"regexp_replace(regexp_replace(regexp_replace(page, {q(DROPPED)}, '', 'g'), {q(BREAKS)}, chr(10), 'g'), {q(TAGS)}, '', 'g')"
    text = f"trim(regexp_replace(regexp_replace({_sql_decoded(text)}, {q(BLANKS)}, ' ', 'g'), {q(LINES)}, chr(10), 'g'), ' ' || chr(10))"
    nl = "chr(13) || chr(10)"
    title = f"trim(regexp_replace(regexp_extract(page, {q(TITLE)}, 1), '\\s+', ' ', 'g'), ' ')"
    return f"""
    WITH source AS (
      SELECT page_id, CAST(page_id AS VARCHAR) AS name, coalesce(url, '') AS target_uri, coalesce(html, '') AS page, 'sha256:' || sha256(coalesce(html, '')) AS source_payload_digest FROM pages),
    described AS (
      SELECT *, 'Content-Type: text/html' || {nl} || 'Content-Length: ' || octet_length(CAST(encode(page) AS BLOB)) AS source_headers,
        {_sql_id("response", "name", "target_uri", "''", "source_payload_digest")} AS refers_to FROM source),
    records AS (
      SELECT *, 'metadata' AS warc_type, {_sql_id("metadata", "refers_to")} AS record_id, 'application/warc-fields' AS content_type,
        'title: ' || {title} || {nl} || 'language: ' || regexp_extract(page, {q(LANGUAGE)}, 1) || {nl} || 'outlinks: ' || len(regexp_extract_all(page, {q(LINKS)}))
        || {nl} || 'source-payload-digest: ' || source_payload_digest || {nl} || source_headers AS block FROM described
      UNION ALL
      SELECT *, 'conversion', {_sql_id("conversion", "refers_to")}, 'text/plain', {text} FROM described)
    SELECT page_id, warc_type, record_id, refers_to, target_uri, CAST(NULL AS VARCHAR) AS refers_to_date, content_type, source_headers,
      source_payload_digest, block, 'sha256:' || sha256(block) AS block_digest, octet_length(encode(block)) AS content_length FROM records"""
