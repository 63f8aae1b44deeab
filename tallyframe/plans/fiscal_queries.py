"""Fiscal series with gaps, and net income of statements that report differently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import batch, fiscal
from tallyframe.plans.registry import query, table

#: Revenue of each priority and quarter, and that of the year so far.
_S = """s AS (SELECT *, CAST(sum(rev) OVER (PARTITION BY batch, y ORDER BY q) AS BIGINT) AS ytd FROM (SELECT o_orderpriority AS batch, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q,
 CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS BIGINT) AS rev FROM {orders} GROUP BY 1, 2, 3))"""
_DUCK = "WITH " + _S.replace("{orders}", "orders")
#: Leap years report three quarters and the year; the next ones only six and nine months; those after three and nine; the years before leap years one quarter that ends in November.
_GAPS = """SELECT batch, y, q, CASE WHEN y % 4 = 0 AND q = 4 THEN 'annual' WHEN y % 4 IN (1, 2) THEN 'ytd' ELSE 'quarter' END AS duration,
 CASE WHEN y % 4 = 0 AND q = 4 THEN 'Year Ended' WHEN y % 4 = 0 OR y % 4 = 3 OR q = 1 THEN 'Three Months Ended' WHEN q = 2 THEN 'Six Months Ended' ELSE 'Nine Months Ended' END AS raw_label,
 CASE WHEN y % 4 = 3 THEN make_date(y, 11, 30) ELSE last_day(make_date(y, q * 3, 1)) END AS day, CASE WHEN y % 4 IN (1, 2) OR (y % 4 = 0 AND q = 4) THEN ytd ELSE rev END AS v FROM s
 WHERE y % 4 = 0 OR (y % 4 = 1 AND q IN (2, 3)) OR (y % 4 = 2 AND q IN (1, 3)) OR (y % 4 = 3 AND q = 4)"""


def _gaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    rows = spark.sql(f"WITH {_S} {_GAPS}", orders=table(spark, d, "orders"))
    facts = rows.selectExpr("batch", "'income' statement", "'Net revenue' canonical", "'Net revenue' label", "0 level", "1 order_index", "concat(raw_label, ' ', day) `column`", "raw_label", "duration", "CAST(day AS STRING) period_end", "CAST(v AS DOUBLE) value", "'a' source", "y * 10 + q AS seq")
    values, lost = fiscal.ingested(facts, ["batch"])
    slots, more = fiscal.slot_keys(fiscal.period_keys(values, ["batch"]), ["batch"])
    series, last = fiscal.fiscal_series(fiscal.slotted(values, slots, ["batch"]), ["batch"])
    return series, values, [lost, more, last]


@query(_DUCK + """ SELECT batch, make_date(y, 12, 31) AS fy_end, CAST(max(rev) FILTER (WHERE q = 1 AND y % 4 IN (0, 2)) AS DOUBLE) AS q1, CAST(max(rev) FILTER (WHERE q = 2 AND y % 4 = 0) AS DOUBLE) AS q2,
  CAST(max(rev) FILTER (WHERE q = 3 AND y % 4 = 0) AS DOUBLE) AS q3, CAST(max(rev) FILTER (WHERE q = 4 AND y % 4 = 0) AS DOUBLE) AS q4, CASE WHEN y % 4 = 0 THEN CAST(sum(rev) AS DOUBLE) END AS fy
 FROM s WHERE y % 4 = 0 OR (y % 4 = 1 AND q IN (2, 3)) OR (y % 4 = 2 AND q IN (1, 3)) GROUP BY batch, y""")
def q75_gap_series(spark: SparkSession, d: str) -> DataFrame:
    """What is known of years that lack quarters: a fourth one by difference, none where earlier ones are missing."""
    return _gaps(spark, d)[0].select("batch", "fy_end", "q1", "q2", "q3", "q4", "fy")


@query(_DUCK + """ SELECT batch, 'income' AS statement, CASE WHEN y % 4 = 3 THEN '' ELSE 'Net revenue' END AS line, CASE WHEN y % 4 = 3 THEN 'quarter-index' ELSE 'ytd-backfill' END AS issue,
  CASE WHEN y % 4 = 3 THEN 'November 30, ' || y ELSE 'FY' || y || ' Q' || q END AS period, CASE WHEN y % 4 = 3 THEN 'Unable to map duration quarter' ELSE 'Missing prior quarters prevents YTD backfill' END AS detail
 FROM s WHERE (y % 4 = 1 AND q IN (2, 3)) OR (y % 4 = 2 AND q = 3) OR (y % 4 = 3 AND q = 4)""")
def q76_gap_issues(spark: SparkSession, d: str) -> DataFrame:
    """Every gap is told: quarters that cannot be filled back, and a period more than a year from the end of its fiscal year."""
    return fiscal.diagnostics(*_gaps(spark, d)[2])


#: Income reports three, six and nine months and quarters of each third year; cash only the year so far; even years are restated by one; the fourth quarter has no cash.
_NET = """SELECT batch, y, q, 'income' AS statement, 'ytd' AS duration, 3 * q AS months, ytd + CASE WHEN y % 2 = 0 THEN 1 ELSE 0 END AS v, 0 AS seq FROM s WHERE q < 4
 UNION ALL SELECT batch, y, q, 'income', 'quarter', 3, rev + 7, 1 FROM s WHERE y % 3 = 0 UNION ALL SELECT batch, y, q, 'cash', 'ytd', 3 * q, ytd, 2 FROM s WHERE q < 4 AND y % 5 <> 0"""


@query(_DUCK + f""", n AS ({_NET}),
 d AS (SELECT a.batch, a.y, a.q, a.statement, 'quarter' AS kind, CAST(a.v - b.v AS DOUBLE) AS v, 1 AS made FROM n a JOIN n b ON a.batch = b.batch AND a.statement = b.statement AND a.y = b.y AND a.q = b.q + 1 AND a.duration = 'ytd' AND b.duration = 'ytd'),
 e AS (SELECT batch, y, q, kind, statement, arg_min(v, made) AS v FROM (SELECT batch, y, q, statement, duration AS kind, CAST(v AS DOUBLE) AS v, 0 AS made FROM n UNION ALL SELECT batch, y, q, statement, kind, v, made FROM d) GROUP BY ALL)
 SELECT batch, kind AS duration, last_day(make_date(y, 3 * q, 1)) AS period_end, max(v) FILTER (WHERE statement = 'income') AS income, max(v) FILTER (WHERE statement = 'cash') AS cash,
  abs(max(v) FILTER (WHERE statement = 'income') - max(v) FILTER (WHERE statement = 'cash')) <= 1e-6 AS ok FROM e GROUP BY batch, kind, y, q""")
def q77_net_income_ytd(spark: SparkSession, d: str) -> DataFrame:
    """Quarters of net income from figures of the year so far, restated ones, and periods that only one statement has."""
    rows = spark.sql(f"WITH {_S} {_NET}", orders=table(spark, d, "orders"))
    store = rows.selectExpr("batch", "statement", "'Net income' label", "duration", "months", "last_day(make_date(y, 3 * q, 1)) period_end", "explode(array(struct(v AS value, seq AS seq), struct(v - 1 AS value, seq - 10 AS seq))) r")
    return batch.net_income_overview(store.select("*", F.col("r.value").cast("double").alias("value"), "r.seq").drop("r"), ["batch"])
