"""Queries over documents and conversations as pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import labels as L
from tallyframe.functions import text as T
from tallyframe.operators import pages as P
from tallyframe.plans.registry import query, table

WORDS = ["the", "and", "der", "que", "tion", "est"]
_WORDS = "['" + "', '".join(WORDS) + "']"
_NORM = r"""array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '-[ \t]*\n\s*', '', 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"""


@query(f"SELECT doc_id, length(n) AS norm_len, length(n) - length(replace(n, chr(10), '')) AS breaks FROM (SELECT doc_id, {_NORM} AS n FROM documents)")
def q01_text_norm(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select("doc_id", T.normalise(F.col("text")).alias("n"))
    return n.select("doc_id", F.length("n").cast("long").alias("norm_len"), (F.length("n") - F.length(F.replace("n", F.lit("\n"), F.lit("")))).cast("long").alias("breaks"))


@query("SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def q02_line_explode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


@query(r"SELECT doc_id, length(text) - length(replace(text, '$', '')) + len(regexp_extract_all(text, '\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b')) AS density FROM documents")
def q03_numeric_density(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.numeric_density(F.col("text")).cast("long").alias("density"))


@query(f"SELECT doc_id, len(list_filter({_WORDS}, lambda w: contains(lower(text), w))) AS hits FROM documents WHERE hits >= 3")
def q04_anchor_hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.anchor_hits(F.col("text"), WORDS).cast("long").alias("hits")).filter("hits >= 3")


_NEAR = "coalesce(length(nullif(regexp_extract(text, '(?s)^.*?the', 0), '')) - 2 BETWEEN 1 AND 501, false)"
_HEAD = "len(list_filter(list_slice(string_split(text, chr(10)), 1, 6), lambda x: regexp_matches(trim(x), '^the'))) > 0"


@query(f"SELECT doc_id, {_NEAR} AS near, {_HEAD} AS heading FROM documents")
def q05_near_top(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.near_top(F.col("text"), "the").alias("near"), T.heading_line(F.col("text"), "the").alias("heading"))


@query(f"""SELECT doc_id FROM documents WHERE length(text) > 0 AND NOT regexp_matches(text, '(?i)\\bItem\\s+7A\\b.*Market\\s+Risk\\b') AND NOT regexp_matches(text, '(?i)Index\\s+to\\s+Consolidated\\s+Financial\\s+Statements')
 AND coalesce(length(nullif(regexp_extract(text, '(?is)^.*?(an|th)', 0), '')) - 1 BETWEEN 1 AND 501, false) AND len(list_filter(list_slice(string_split(text, chr(10)), 1, 6), lambda x: regexp_matches(trim(x), '(?i)^(an|th)'))) > 0
 AND len(list_filter({_WORDS}, lambda w: contains(lower(text), w))) >= 2""")
def q06_valid_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(T.statement_page(F.col("text"), "(?i)(an|th)", WORDS, 2, 0)).select("doc_id")


@query("SELECT conv_id, sum(length(text)) AS chars FROM conversations WHERE turn < 8 GROUP BY conv_id HAVING sum(length(text)) < 2000")
def q07_low_text(spark: SparkSession, d: str) -> DataFrame:
    return P.low_text(table(spark, d, "conversations"), "conv_id", "turn", "text").withColumn("chars", F.col("chars").cast("long"))


@query("""SELECT hint, (m).page AS page, (m).far AS distance FROM (
 SELECT h.hint, min({'far': abs(v.page - h.hint), 'page': v.page}) AS m FROM (SELECT doc_id + 7 AS hint FROM documents) h
 JOIN (SELECT doc_id AS page FROM documents WHERE lang = 'de') v ON abs(v.page - h.hint) <= 20 GROUP BY h.hint)""")
def q08_nearest_page(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hints = docs.select((F.col("doc_id") + 7).alias("hint"))
    return P.nearest_page(hints, docs.filter("lang = 'de'").select(F.col("doc_id").alias("page")), "hint", "page")


@query(r"""SELECT doc_id, (m).line_no AS line_no, (m).number AS number FROM (SELECT doc_id, min({'line_no': line_no, 'number': CAST(number AS BIGINT)}) AS m FROM (
 SELECT doc_id, line_no, nullif(regexp_extract(line, '(\d{1,3})\s*$', 1), '') AS number FROM (
 SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text || chr(10) || 'see page ' || (n_chars % 1000) || chr(10) || 'end', chr(10)) AS l FROM documents))) WHERE number IS NOT NULL GROUP BY doc_id)""")
def q09_toc_first_match(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.concat("text", F.lit("\nsee page "), F.col("n_chars") % 1000, F.lit("\nend")), "\n")).alias("line_no", "line"))
    numbered = lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.trailing_page_number(F.col("line")).cast("long").alias("number"))
    return P.first_match(numbered, "doc_id", ["line_no"], "number")


@query("""SELECT conv_id, turn, CAST(CASE WHEN o1 AND o2 THEN 2 WHEN o1 THEN 1 ELSE 0 END AS BIGINT) AS extra FROM (
 SELECT conv_id, turn, text, coalesce(lead(length(text) > 300, 1) OVER w, false) AS o1, coalesce(lead(length(text) > 300, 2) OVER w, false) AS o2, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""")
def q10_continuation(spark: SparkSession, d: str) -> DataFrame:
    found = P.continuations(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user", F.length("text") > 300)
    return found.withColumn("extra", F.col("extra").cast("long"))


@query("SELECT conv_id, turn, last_value(CASE WHEN length(text) % 3 = 0 THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS statement FROM conversations")
def q11_ffill_statement(spark: SparkSession, d: str) -> DataFrame:
    return P.fill_statement(table(spark, d, "conversations"), "conv_id", "turn", F.when(F.length("text") % 3 == 0, F.col("role"))).select("conv_id", "turn", "statement")


@query("SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY conv_id, role")
def q12_dedup_order(spark: SparkSession, d: str) -> DataFrame:
    return P.first_occurrence(table(spark, d, "conversations"), ["conv_id"], "role", ["turn"])


@query("""WITH p AS (SELECT source, doc_id, n_chars % 3 AS kind FROM documents),
 h AS (SELECT source, doc_id, max(CASE WHEN kind = 0 THEN doc_id END) OVER w AS a, max(CASE WHEN kind = 1 THEN doc_id END) OVER w AS b, max(CASE WHEN kind = 2 THEN doc_id END) OVER w AS c
 FROM p WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT source, greatest(a, b, c) - least(a, b, c) AS span, greatest(a, b, c) AS last_page, least(a, b, c) AS first_page FROM h WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)
 SELECT source, (m).span AS span, (m).last_page AS last_page, (m).first_page AS first_page FROM (SELECT source, min({'span': span, 'last_page': last_page, 'first_page': first_page}) AS m FROM s GROUP BY source)""")
def q43_min_span(spark: SparkSession, d: str) -> DataFrame:
    return P.least_span(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", F.col("n_chars") % 3, [0, 1, 2])


@query("""SELECT doc_id, CAST(len(r) AS BIGINT) AS n, array_to_string(r, ',') AS reasons FROM (SELECT doc_id, CASE WHEN l = '' THEN ['missing_label'] ELSE list_filter([
 CASE WHEN contains(lower(l), 'see accompanying') THEN 'footnote_fragment' END, CASE WHEN regexp_matches(l, '\\d') THEN 'contains_digits' END, CASE WHEN regexp_matches(l, '[:,;]$') THEN 'dangling_punctuation' END,
 CASE WHEN contains(l, '(') AND NOT contains(l, ')') THEN 'dangling_parenthesis' END, CASE WHEN NOT regexp_matches(l, '[A-Za-z]') THEN 'non_text_label' END,
 CASE WHEN lower(l) IN ('respectively', 'issued', 'none issued') THEN 'standalone_fragment' END], lambda x: x IS NOT NULL) END AS r FROM (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS l FROM documents))""".replace("\\\\", "\\"))
def q46_suspect_reasons(spark: SparkSession, d: str) -> DataFrame:
    label = F.btrim(F.split_part("text", F.lit("\n"), F.lit(1)))
    found = table(spark, d, "documents").select("doc_id", L.suspicions(label).alias("r"))
    return found.select("doc_id", F.size("r").cast("long").alias("n"), F.array_join("r", ",").alias("reasons"))


@query("SELECT doc_id, quality FROM labels WHERE (CASE WHEN doc_id % 4 = 0 THEN NULL ELSE quality END) IS NULL OR quality >= 1")
def q47_confidence(spark: SparkSession, d: str) -> DataFrame:
    from tallyframe.operators.review import confident

    rows = table(spark, d, "labels").withColumn("confidence", F.when(F.col("doc_id") % 4 != 0, F.col("quality")))
    return confident(rows, 1).select("doc_id", "quality")
