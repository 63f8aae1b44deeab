"""Queries over reports built from the tables: checks, fiscal series, page selection, extraction.

What is a report here is plain SQL that Spark and DuckDB both run; the operators work on its rows in
Spark, and the oracle states the expected rows from the same figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import lines as N
from tallyframe.functions import rewrites as W
from tallyframe.operators import batch, certify, documents, extract, fiscal, select
from tallyframe.plans.registry import query, table

#: Quarters of each order priority in whole units, with cash that runs on.
_QUARTERS = """q0 AS (SELECT o_orderpriority AS batch, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q,
   CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS BIGINT) AS rev, CAST(floor(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END)) AS BIGINT) AS cost FROM {orders} GROUP BY 1, 2, 3),
 q1 AS (SELECT *, last_day(make_date(y, q * 3, 1)) AS period_end, CAST(floor(CAST(rev AS DOUBLE) / 4) AS BIGINT) AS opex, CAST(floor(CAST(rev AS DOUBLE) / 8) AS BIGINT) AS tax, CASE WHEN q = 2 THEN 0 ELSE 2 END AS fx FROM q0),
 q2 AS (SELECT *, rev - cost - 5 + fx AS delta, CAST(sum(rev - cost - 5 + fx) OVER (PARTITION BY batch ORDER BY y, q) AS BIGINT) AS ending FROM q1)"""
_LINES = [
    ("income", "Net revenue", "rev", "true"),
    ("income", "Cost of revenue", "-cost", "true"),
    ("income", "Gross profit", "rev - cost + CASE WHEN (y + q) % 5 = 0 THEN 1 ELSE 0 END", "(y * 4 + q) % 7 <> 0"),
    ("income", "Total operating expenses", "opex", "true"),
    ("income", "Operating income", "rev - cost - opex", "true"),
    ("income", "Interest and other income", "10", "true"),
    ("income", "Income before taxes", "rev - cost - opex + 10", "true"),
    ("income", "Provision for income taxes", "-tax", "true"),
    ("income", "Net income", "rev - cost - opex + 10 - tax", "true"),
    ("cash", "Net income", "rev - cost - opex + 10 - tax + CASE WHEN q = 4 AND y = 1997 THEN 1 ELSE 0 END", "true"),
    ("cash", "Net cash provided by operating activities", "rev", "true"),
    ("cash", "Net cash used in investing activities", "-cost", "true"),
    ("cash", "Net cash used in financing activities", "-5", "true"),
    ("cash", "Effect of exchange rates", "fx", "q <> 2"),
    ("cash", "Increase (decrease) in cash and cash equivalents", "delta", "true"),
    ("cash", "Beginning cash and cash equivalents", "ending - delta", "true"),
    ("cash", "Ending cash and cash equivalents", "ending", "(y * 4 + q) % 9 <> 0"),
    ("balance", "Total assets", "2 * ending", "true"),
    ("balance", "Total liabilities", "ending", "(y * 4 + q) % 8 <> 0"),
    ("balance", "Total stockholders'' equity", "ending + CASE WHEN (y + q) % 6 = 0 THEN 1 ELSE 0 END", "true"),
    ("balance", "Cash and cash equivalents", "ending", "(y * 4 + q) % 11 <> 0"),
]
_DERIVED = "CASE WHEN q = 3 THEN ' (derived)' ELSE '' END"
_V = {(s, label): f"CASE WHEN {there} THEN CAST({value} AS DOUBLE) END" for s, label, value, there in _LINES}


def _duck(sql: str) -> str:
    return sql.replace("{orders}", "orders")


def _d(tag: str, delta: str, derived: bool = True) -> str:
    return f"'{tag}Δ ' || format('{{:.6g}}', {delta})" + (f" || {_DERIVED}" if derived else "")


def _check(name: str, detail: str, ok: str, there: str = "true") -> str:
    return f"SELECT batch, '{name}' AS \"check\", CASE WHEN bool_and({ok}) THEN 'PASS' ELSE 'CHECK' END AS result, string_agg({detail}, '; ' ORDER BY period_end) AS details FROM w WHERE {there} GROUP BY batch"


_WIDE = ", ".join(f"{_V[k]} AS {n}" for n, k in {
    "rv": ("income", "Net revenue"), "co": ("income", "Cost of revenue"), "gp": ("income", "Gross profit"), "ox": ("income", "Total operating expenses"), "oi": ("income", "Operating income"),
    "ot": ("income", "Interest and other income"), "pt": ("income", "Income before taxes"), "tx": ("income", "Provision for income taxes"), "ni": ("income", "Net income"), "cn": ("cash", "Net income"),
    "ca": ("cash", "Net cash provided by operating activities"), "cb": ("cash", "Net cash used in investing activities"), "cc": ("cash", "Net cash used in financing activities"), "ex": ("cash", "Effect of exchange rates"),
    "ch": ("cash", "Increase (decrease) in cash and cash equivalents"), "be": ("cash", "Beginning cash and cash equivalents"), "en": ("cash", "Ending cash and cash equivalents"),
    "ta": ("balance", "Total assets"), "tl": ("balance", "Total liabilities"), "eq": ("balance", "Total stockholders'' equity"), "bc": ("balance", "Cash and cash equivalents"),
}.items())
_W = f"WITH {_duck(_QUARTERS)}, w0 AS (SELECT batch, y, q, period_end, {_WIDE} FROM q2), w AS (SELECT w0.*, strftime(period_end, '%B %d, %Y') AS day, (SELECT max(b.bc) FROM w0 b WHERE b.batch = w0.batch AND b.period_end = last_day(w0.period_end - INTERVAL 3 MONTH)) AS bc0 FROM w0)"
_OK = lambda x: f"abs({x}) <= 1e-6"
_BATCH_SQL = _W + " " + " UNION ALL ".join([
    _check(batch.BALANCE, f"day || ': ' || CASE WHEN tl IS NULL THEN 'insufficient data' ELSE {_d('', 'ta - (tl + eq)', False)} END", f"coalesce({_OK('ta - (tl + eq)')}, false)"),
    _check(batch.ROLL, f"'3M ended ' || day || ': ' || {_d('roll ', 'be + ch - en')} || '; ' || CASE WHEN bc IS NULL THEN 'missing BS cash at end' ELSE {_d('end tie ', 'en - bc')} END || '; ' || CASE WHEN bc0 IS NULL THEN 'missing BS cash at start' ELSE 'start tie Δ ' || format('{{:.6g}}', be - bc0) || CASE WHEN q IN (3, 4) THEN ' (derived)' ELSE '' END END",
           f"{_OK('be + ch - en')} AND coalesce({_OK('en - bc')}, false) AND coalesce({_OK('be - bc0')}, false)", "en IS NOT NULL").replace("{{:.6g}}", "{:.6g}"),
    _check(batch.NET, f"'3M ended ' || day || ': ' || {_d('', 'ni - cn')}", _OK("ni - cn")),
    _check(batch.INCOME, f"'3M ended ' || day || ': ' || CASE WHEN gp IS NULL THEN 'insufficient data (GP), insufficient data (OI)' ELSE {_d('GP ', '(rv + co) - gp')} || ', ' || {_d('OI ', '(gp - ox) - oi')} END || ', ' || {_d('PT ', '(oi + ot) - pt')} || ', ' || {_d('NI ', '(pt + tx) - ni')}",
           f"gp IS NOT NULL AND {_OK('(rv + co) - gp')} AND {_OK('(gp - ox) - oi')} AND {_OK('(oi + ot) - pt')} AND {_OK('(pt + tx) - ni')}"),
    _check(batch.CASH, f"'3M ended ' || day || ': ' || {_d('', '(ca + cb + cc + coalesce(ex, 0)) - ch')}", _OK("(ca + cb + cc + coalesce(ex, 0)) - ch")),
])


def _text(label: str) -> str:
    return '"' + label.replace("''", "'") + '"'


def _quarters(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"WITH {_QUARTERS} SELECT * FROM q2", orders=table(spark, d, "orders"))


def _store(spark: SparkSession, d: str) -> DataFrame:
    lines = [
        f"struct('{s}' AS statement, {_text(label)} AS label, '{'point' if s == 'balance' else 'quarter'}' AS duration, {'CAST(NULL AS INT)' if s == 'balance' else '3'} AS months, {_V[(s, label)]} AS value, {i} AS seq)"
        for i, (s, label, _, _) in enumerate(_LINES)
    ]
    each = _quarters(spark, d).selectExpr("batch", "period_end", "q = 3 AS derived", f"inline(array({', '.join(lines)}))")
    return each.filter("value is not null").withColumn("duration_key", F.col("duration"))


@query(_BATCH_SQL)
def q60_batch_checks(spark: SparkSession, d: str) -> DataFrame:
    return batch.certify_batches(_store(spark, d), ["batch"])


#: Checks by name: difference, and the columns it needs.
_IDENTITIES = {
    "balance equality": ("ta - (tl + eq)", "ta tl eq"), "cash roll": ("be + ch - en", "be ch en"), "net income link": ("ni - cn", "ni cn"), "gross profit": ("rv + co - gp", "rv co gp"),
    "operating income": ("gp - ox - oi", "gp ox oi"), "pretax income": ("oi + ot - pt", "oi ot pt"), "net income": ("pt + tx - ni", "pt tx ni"), "cash flow": ("ca + cb + cc + coalesce(ex, 0) - ch", "ca cb cc ch"),
}


def _identity(name: str, delta: str, needs: str) -> str:
    every, some = (f" {word} ".join(f"{c} IS NOT NULL" for c in needs.split()) for word in ("AND", "OR"))
    return f"SELECT batch, '{name}' AS \"check\", coalesce(({every}) AND abs({delta}) <= 1e-6, false) AS ok FROM w WHERE {some}"


@query(f"""{_W}, i AS ({' UNION ALL '.join(_identity(n, *x) for n, x in _IDENTITIES.items())})
 SELECT batch AS doc_id, "check", CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'CHECK' END AS result, count(*) AS periods, count(*) FILTER (WHERE NOT ok) AS failed FROM i GROUP BY ALL""")
def q57_demo_certification(spark: SparkSession, d: str) -> DataFrame:
    """The checks that the demo filing is made for, over each priority's quarters as one document."""
    facts = _store(spark, d).selectExpr("batch AS doc_id", "statement", "label", "seq AS order_index", "CAST(period_end AS STRING) AS period", "value")
    return certify.certify(facts)


_NOT_SUB = "SELECT batch, duration, period_end, income, cash, abs(income - cash) <= 1e-6 AS ok FROM (SELECT batch, 'quarter' AS duration, period_end, ni AS income, cn AS cash FROM w)"


@query(_W + " " + _NOT_SUB)
def q61_net_income_overview(spark: SparkSession, d: str) -> DataFrame:
    return batch.net_income_overview(_store(spark, d), ["batch"])


def _document(name: str, detail: str, ok: str) -> str:
    return f"SELECT batch AS doc_id, '{name}' AS \"check\", CASE WHEN bool_and({ok}) THEN 'PASS' ELSE 'CHECK' END AS result, string_agg('Q' || q || ' ' || y || ': ' || {detail}, '; ' ORDER BY period_end) AS details FROM w GROUP BY batch"


_LACKS = "'insufficient data'"
_DOCUMENT_SQL = _W + " " + " UNION ALL ".join([
    _document(batch.BALANCE, f"CASE WHEN tl IS NULL THEN {_LACKS} ELSE {_d('', 'ta - (tl + eq)', False)} END", f"coalesce({_OK('ta - (tl + eq)')}, false)"),
    _document(batch.ROLL, f"CASE WHEN en IS NULL THEN {_LACKS} ELSE {_d('roll ', 'be + ch - en', False)} || CASE WHEN bc IS NULL THEN '' ELSE '; ' || {_d('tie ', 'en - bc', False)} END END", f"coalesce({_OK('be + ch - en')}, false) AND coalesce({_OK('en - bc')}, true)"),
    _document(batch.NET, _d("", "ni - cn", False), _OK("ni - cn")),
    _document(batch.INCOME, f"CASE WHEN gp IS NULL THEN '' ELSE {_d('GP ', '(rv + co) - gp', False)} || ', ' || {_d('OI ', '(gp - ox) - oi', False)} || ', ' END || {_d('PT ', '(oi + ot) - pt', False)} || ', ' || {_d('NI ', '(pt + tx) - ni', False)}",
              f"(gp IS NULL OR ({_OK('(rv + co) - gp')} AND {_OK('(gp - ox) - oi')})) AND {_OK('(oi + ot) - pt')} AND {_OK('(pt + tx) - ni')}"),
    _document(batch.CASH, _d("", "(ca + cb + cc + coalesce(ex, 0)) - ch", False), _OK("(ca + cb + cc + coalesce(ex, 0)) - ch")),
    f"SELECT DISTINCT batch, '{documents.COVERAGE}', 'PASS', 'Captured pages: . Columns reordered oldest→newest.' FROM w",
    f"SELECT DISTINCT batch, '{documents.UNITS}', 'PASS', '{documents.UNITS_TEXT}' FROM w",
])


@query(_DOCUMENT_SQL)
def q62_document_checks(spark: SparkSession, d: str) -> DataFrame:
    lines = [f"struct('{s}' AS statement, {i} AS order_index, {_text(label)} AS label, '{'point' if s == 'balance' else 'quarter'}' AS duration, {_V[(s, label)]} AS value)" for i, (s, label, _, _) in enumerate(_LINES)]
    facts = _quarters(spark, d).selectExpr("batch AS doc_id", "q - 1 + 4 * (y - 1990) AS col_ord", "concat('Q', q, ' ', y) AS column", "CAST(period_end AS STRING) AS period_end", f"inline(array({', '.join(lines)}))")
    return documents.certify_documents(facts)


#: Reports of each priority's revenue: by year quarters, year to date, three quarters and the year, or a mixture; and a column without a date.
_RAW = "CASE WHEN duration = 'annual' THEN 'Year Ended ' WHEN q = 1 THEN 'Three Months Ended ' WHEN duration = 'quarter' THEN 'Three Months Ended ' WHEN q = 2 THEN 'Six Months Ended ' WHEN q = 3 THEN 'Nine Months Ended ' ELSE 'Twelve Months Ended ' END"
_KIND = "CASE WHEN y % 4 = 0 OR (y % 4 = 2 AND q < 4) OR (y % 4 = 3 AND q = 1) THEN 'quarter' WHEN y % 4 IN (2, 3) AND q = 4 THEN 'annual' ELSE 'ytd' END"
_S = f"WITH {_duck(_QUARTERS)}, s AS (SELECT *, CAST(sum(rev) OVER (PARTITION BY batch, y ORDER BY q) AS BIGINT) AS ytd, max(q) OVER (PARTITION BY batch, y) AS most FROM q2)"
_MEASURE_SQL = _S + """
 SELECT batch, 'income' AS statement, 'net revenue' AS label, 'quarter' AS duration_key, period_end, 3 AS months, CAST(rev AS DOUBLE) AS value, NOT (y % 4 = 0 OR (y % 4 = 2 AND q < 4) OR (y % 4 = 3 AND q = 1)) AS derived FROM s
 UNION ALL SELECT batch, 'income', 'net revenue', 'ytd' || (3 * q), period_end, 3 * q, CAST(ytd AS DOUBLE), false FROM s WHERE y % 4 = 1 OR (y % 4 = 3 AND q IN (2, 3))
 UNION ALL SELECT batch, 'income', 'net revenue', 'annual', period_end, 12, CAST(ytd AS DOUBLE), y % 4 < 2 FROM s WHERE q = 4
 UNION ALL SELECT batch, 'balance', 'total assets', 'point', period_end, NULL, CAST(2 * ending AS DOUBLE), false FROM s"""


def _reports(spark: SparkSession, d: str) -> DataFrame:
    kinds = _quarters(spark, d).selectExpr("*", "CAST(sum(rev) OVER (PARTITION BY batch, y ORDER BY q) AS BIGINT) AS ytd", f"{_KIND} AS duration").selectExpr("*", f"{_RAW} AS raw", "CAST(period_end AS STRING) AS day")
    row = "struct('{}' AS statement, '{}' AS canonical, {} AS column, {} AS raw_label, {} AS duration, {} AS period_end, CAST({} AS DOUBLE) AS value, {} AS seq)"
    rows = [
        row.format("income", "Net revenue", "concat(raw, day)", "raw", "duration", "day", "CASE WHEN duration = 'quarter' THEN rev ELSE ytd END", "y * 10 + q"),
        row.format("balance", "Total assets", "day", "''", "'point'", "day", "2 * ending", "y * 10 + q"),
        "CASE WHEN q = 1 THEN " + row.format("income", "Net revenue", "'Restated'", "'Restated'", "'annual'", "''", "1.0", "1") + " END",
    ]
    each = kinds.selectExpr("batch", f"explode(array_compact(array({', '.join(rows)}))) AS r").selectExpr("batch", "r.*")
    return each.selectExpr("*", "canonical AS label", "0 AS level", "1 AS order_index", "'a' AS source")


@query(_MEASURE_SQL)
def q63_measurements(spark: SparkSession, d: str) -> DataFrame:
    values, _ = fiscal.ingested(_reports(spark, d), ["batch"])
    slots, _ = fiscal.slot_keys(fiscal.period_keys(values, ["batch"]), ["batch"])
    return fiscal.measurements(values, slots, ["batch"]).select("batch", "statement", "label", "duration_key", "period_end", "months", "value", "derived")


@query(_S + """ SELECT batch, statement, line, fy_end, max(v) FILTER (WHERE q = 1) AS q1, max(v) FILTER (WHERE q = 2) AS q2, max(v) FILTER (WHERE q = 3) AS q3, max(v) FILTER (WHERE q = 4) AS q4,
  CASE WHEN max(most) = 4 THEN CAST(sum(v) AS DOUBLE) END AS fy FROM (
  SELECT batch, 'income' AS statement, 'net revenue' AS line, make_date(y, 12, 31) AS fy_end, q, CAST(rev AS DOUBLE) AS v, most FROM s UNION ALL SELECT batch, 'balance', 'total assets', make_date(y, 12, 31), q, CAST(2 * ending AS DOUBLE), most FROM s) GROUP BY batch, statement, line, fy_end""")
def q64_fiscal_series(spark: SparkSession, d: str) -> DataFrame:
    values, _ = fiscal.ingested(_reports(spark, d), ["batch"])
    slots, _ = fiscal.slot_keys(fiscal.period_keys(values, ["batch"]), ["batch"])
    return fiscal.fiscal_series(fiscal.slotted(values, slots, ["batch"]), ["batch"])[0].select("batch", "statement", "line", "fy_end", "q1", "q2", "q3", "q4", "fy")


@query("SELECT DISTINCT o_orderpriority AS batch, 'income' AS statement, 'Net revenue' AS line, 'missing-period' AS issue, 'Restated' AS period, 'Could not parse period end date' AS detail FROM orders")
def q65_ingest_issues(spark: SparkSession, d: str) -> DataFrame:
    values, lost = fiscal.ingested(_reports(spark, d), ["batch"])
    slots, more = fiscal.slot_keys(fiscal.period_keys(values, ["batch"]), ["batch"])
    last = fiscal.fiscal_series(fiscal.slotted(values, slots, ["batch"]), ["batch"])[1]
    return fiscal.diagnostics(lost, more, last).distinct()


_MONEY = "concat(chr(10), '1,234 $ 2,345 $ 3,456', chr(10), '4,567 5,678 6,789 7,890')"
_ANCHORED = {
    "income": "'revenue cost of revenue gross profit net income research and development'",
    "balance": "'total assets total liabilities accounts receivable deferred revenue'",
    "cash": "'operating activities investing activities financing activities'",
}
_PAGES = f"""SELECT CAST(floor(doc_id / 20) AS BIGINT) AS doc_id, CAST(doc_id % 20 AS INT) AS page_idx, CASE
 WHEN doc_id % 20 = 1 THEN concat('Table of Contents', chr(10), 'Financial Statements and Data 12')
 WHEN doc_id % 20 = 10 AND floor(doc_id / 20) % 3 <> 0 THEN concat('Index to Consolidated Financial Statements', chr(10), 'Consolidated Balance Sheets 13', chr(10), 'Consolidated Statements of Operations 12', chr(10), 'Consolidated Statements of Cash Flows 15')
 WHEN doc_id % 20 = 11 THEN concat('CONSOLIDATED STATEMENTS OF OPERATIONS', chr(10), {_ANCHORED['income']}, {_MONEY})
 WHEN doc_id % 20 = 12 THEN concat('CONSOLIDATED BALANCE SHEETS', chr(10), {_ANCHORED['balance']}, {_MONEY})
 WHEN doc_id % 20 = 13 AND floor(doc_id / 20) % 2 = 0 THEN concat('Continued (continued)', chr(10), {_ANCHORED['balance']}, {_MONEY})
 WHEN doc_id % 20 = 14 THEN concat('CONSOLIDATED STATEMENTS OF CASH FLOWS', chr(10), {_ANCHORED['cash']}, {_MONEY})
 ELSE text END AS text FROM {{documents}}"""


@query("""SELECT CAST(floor(doc_id / 20) AS BIGINT) AS doc_id, CASE doc_id % 20 WHEN 11 THEN 'income' WHEN 14 THEN 'cash' ELSE 'balance' END AS statement, CAST(doc_id % 20 AS INT) AS page_idx FROM documents
 WHERE doc_id % 20 IN (11, 12, 14) OR (doc_id % 20 = 13 AND floor(doc_id / 20) % 2 = 0)""")
def q66_select_pages(spark: SparkSession, d: str) -> DataFrame:
    return select.select_pages(spark.sql(_PAGES, documents=table(spark, d, "documents"))).select("doc_id", "statement", "page_idx")


_ENDS = ["concat(p_name, ' (1)')", "concat(p_name, ', respectively')", "concat(p_name, ' (In millions)')", "concat(p_name, ' of the')", "concat('  ', p_name, ':')", "concat(p_name, ' and, or')", "concat('(in thousands) ', p_name)", "concat(p_name, ' common stock, shares issued 12')", "concat('Income before taxes on ', p_name)"]
_PRINTED = "SELECT p_partkey, CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_ENDS)) + " END AS printed FROM {part}"


@query("SELECT p_partkey, CASE p_partkey % 9 WHEN 2 THEN p_name || ' (' WHEN 6 THEN '' WHEN 7 THEN 'Common stock' WHEN 8 THEN 'Income before income taxes' ELSE p_name END AS label FROM part")
def q67_clean_labels(spark: SparkSession, d: str) -> DataFrame:
    printed = spark.sql(_PRINTED, part=table(spark, d, "part"))
    return printed.select("p_partkey", W.canonical_name(W.clean_label(F.col("printed")), F.col("printed")).alias("label"))


_RAWS = ["'For the Three Months Ended '", "'Year Ended '", "''", "'(In millions) Nine  months ended Six Months Ended '"]


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Three Months Ended ' WHEN 1 THEN 'Year Ended ' WHEN 2 THEN '' ELSE 'Six Months Ended ' END || strftime(o_orderdate, '%B %-d, %Y') AS label FROM orders")
def q68_column_labels(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    raw = F.concat(F.expr("CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN {r}" for i, r in enumerate(_RAWS)) + " END"), F.date_format("o_orderdate", "MMMM d, yyyy"))
    return o.select("o_orderkey", N.column_label(raw, F.lit(0), F.lit(2)).alias("label"))


_BY_KIND = "SELECT o_custkey AS doc_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Urgent' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium' WHEN '4' THEN 'Unspecified' ELSE 'Low' END AS kind, min(o_orderpriority) AS p, count(*) AS n, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS BIGINT) AS total FROM {orders} GROUP BY 1, 2"
_WORDS = f"""WITH k AS ({_BY_KIND}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS nth FROM k)
 SELECT doc_id, 0 AS page_idx, '2000' AS text, 300.0 AS x0, 320.0 AS x1, 10.0 AS top FROM (SELECT DISTINCT doc_id FROM r) UNION ALL SELECT doc_id, 0, '2001', 400.0, 420.0, 10.0 FROM (SELECT DISTINCT doc_id FROM r)
 UNION ALL SELECT doc_id, 0, kind, 50.0, 80.0, 10.0 + 10 * nth FROM r UNION ALL SELECT doc_id, 0, 'deliveries', 90.0, 130.0, 10.0 + 10 * nth FROM r
 UNION ALL SELECT doc_id, 0, format_number(n, 0), 305.0, 318.0, 10.0 + 10 * nth FROM r
 UNION ALL SELECT doc_id, 0, CASE WHEN n % 2 = 0 THEN concat('(', format_number(total, 0), ')') ELSE format_number(total, 0) END, 385.0, 420.0, 10.0 + 10 * nth FROM r"""


@query(f"""WITH k AS ({_BY_KIND.replace('{orders}', 'orders')}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS nth FROM k)
 SELECT doc_id, CAST(nth AS INT) AS order_index, 0 AS level, kind || ' deliveries' AS label, c AS col_ord, CAST(2000 + c AS VARCHAR) AS "column", 'point' AS duration, CAST(2000 + c AS VARCHAR) AS period_end,
 CAST(CASE WHEN c = 0 THEN n WHEN n % 2 = 0 THEN -total ELSE total END AS DOUBLE) AS value FROM r, (VALUES (0), (1)) AS t(c)""")
def q69_extract_tables(spark: SparkSession, d: str) -> DataFrame:
    words = spark.sql(_WORDS, orders=table(spark, d, "orders")).withColumn("statement", F.lit("balance"))
    found = extract.table_rows(words.selectExpr("doc_id", "statement", "page_idx", "text", "CAST(x0 AS DOUBLE) x0", "CAST(x1 AS DOUBLE) x1", "CAST(top AS DOUBLE) top"), ["doc_id", "statement"])
    return found.select("doc_id", "order_index", "level", "label", "col_ord", "column", "duration", "period_end", "value")


@query("""WITH w AS (SELECT l_partkey AS part, year(l_shipdate) AS year, sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'A') AS a, sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag <> 'A') AS n, sum(CAST(l_quantity AS BIGINT)) AS t FROM lineitem GROUP BY 1, 2)
 SELECT part, 'parts' AS "check", 'CHECK' AS result, count(*) AS periods, count(*) FILTER (WHERE a IS NULL OR n IS NULL) AS failed FROM w GROUP BY part HAVING count(*) FILTER (WHERE a IS NULL OR n IS NULL) > 0""")
def q70_part_issues(spark: SparkSession, d: str) -> DataFrame:
    """Parts that lack returned or other items in some year: a check that has data to fail on."""
    n, flag = F.col("l_quantity").cast("long"), F.col("l_returnflag")
    wide = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.year("l_shipdate").alias("year")).agg(F.sum(F.when(flag == "A", n)).alias("a"), F.sum(F.when(flag != "A", n)).alias("n"), F.sum(n).alias("t"))
    rows = certify.identities(wide, {"parts": ((F.col("a") + F.col("n") - F.col("t")).cast("double"), ["a", "n", "t"], [])}, ["part", "year"])
    return certify.issues(certify.verdicts(rows, ["part"]))
