"""Certification of single documents: seven checks, each with a verdict and the differences by column.

Facts: doc_id, statement, order_index, label, col_ord, column, duration, period_end (as text), value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import describe as D
from tallyframe.operators import batch as B
from tallyframe.tables import written

# Statement, role and the label pattern of its line; the first line that fits is taken.
ROLES = [
    ("balance", "assets", r"total assets"),
    ("balance", "liabilities", r"total liabilities"),
    ("balance", "equity", r"total\s+(?!liabilities)(?!.*stockholders)(?!.*shareholders).*equity$"),
    ("balance", "equity_named", r"total\s+(?!liabilities)(?:.*stockholders[’']?\s+equity|.*shareholders[’']?\s+equity)"),
    ("balance", "bs_cash", r"cash and cash equivalents"),
    ("cash", "begin", r"beginning cash and cash equivalents"),
    ("cash", "change", r"^(?:increase|decrease)"),
    ("cash", "end", r"ending cash and cash equivalents"),
    ("cash", "cf_net", r"^net income"),
    ("cash", "cfo", r"^net cash .*operating activities"),
    ("cash", "cfi", r"^net cash .*investing activities"),
    ("cash", "cff", r"^net cash .*financing activities"),
    ("cash", "fx", r"effect of .*exchange"),
    ("income", "is_net", r"^net income"),
    ("income", "revenue", r"^net revenue|^revenue|^sales$"),
    ("income", "cost", r"^cost of revenue|^cost of sales$"),
    ("income", "gross", r"^gross profit$"),
    ("income", "opex", r"^total operating expenses$"),
    ("income", "opinc", r"^operating income$"),
    ("income", "other", r"other income|interest and other income"),
    ("income", "pretax", r"income before"),
    ("income", "tax", r"^provision.*income taxes"),
]
NAMES = [r for _, r, _ in ROLES]
COVERAGE, UNITS = "Coverage & ordering", "Units/scale normalization"
UNITS_TEXT = "Original units per headers; monetary values saved in USD millions; per-share, shares, %/ratios left unscaled."


def columns_of(facts: DataFrame) -> DataFrame:
    """doc_id, statement, col_ord, column, duration, period_end and the value of each role's line (null: no line or no value)."""
    fits = F.array_compact(F.array(*[F.when((F.col("statement") == s) & F.col("label").rlike("(?i)" + p), F.lit(r)) for s, r, p in ROLES]))
    by = ["doc_id", "statement", "col_ord", "column", "duration", "period_end"]
    each = facts.withColumn("role", F.explode_outer(fits))
    wide = each.groupBy(*by).pivot("role", NAMES).agg(F.min_by(F.struct("value"), "order_index"))
    # where a line fits the first equity pattern, the second is not asked, whatever the values
    value = lambda r: F.col(f"{r}.value").alias(r)
    equity = F.when(F.col("equity").isNotNull(), F.col("equity.value")).otherwise(F.col("equity_named.value"))
    return wide.select(*by, equity.alias("equity"), *[value(r) for r in NAMES if r not in ("equity", "equity_named")])


def _every(roles: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(r).isNotNull() for r in roles])


def _ok(delta: Column) -> Column:
    return F.abs(delta) <= B.TOLERANCE


def _told(rows: DataFrame, check: str, ok: Column, said: Column) -> DataFrame:
    """doc_id, check, result, details: one detail a column, in order."""
    each = rows.select("doc_id", "col_ord", ok.alias("ok"), F.concat("column", F.lit(": "), said).alias("detail"))
    put = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_ord", "detail"))), lambda x: x["detail"]), "; ")
    return each.groupBy("doc_id").agg(F.when(F.bool_and("ok"), "PASS").otherwise("CHECK").alias("result"), put.alias("details")).select("doc_id", F.lit(check).alias("check"), "result", "details")


def _simple(rows: DataFrame, check: str, roles: list[str], delta: Column) -> DataFrame:
    whole = _every(roles)
    return _told(rows, check, F.when(whole, _ok(delta)).otherwise(False), F.when(whole, D.delta_text("", delta)).otherwise("insufficient data"))


def cash_roll(wide: DataFrame) -> DataFrame:
    """C2: beginning and change against the end, and the end against the balance's cash of the same period, if it has any."""
    period = D.period_signature(F.col("column"), F.col("period_end"))["period"]
    ends = wide.filter("statement = 'balance'").groupBy(F.col("doc_id").alias("b_doc"), period.alias("b_period")).agg(F.max_by(F.struct("bs_cash"), "col_ord").alias("b"))
    rows = wide.filter("statement = 'cash'").drop("bs_cash").withColumn("period", period).join(ends, (F.col("doc_id") == F.col("b_doc")) & (F.col("period") == F.col("b_period")), "left")
    roll, tie = F.col("begin") + F.col("change") - F.col("end"), F.col("end") - F.col("b.bs_cash")
    whole = _every(["begin", "change", "end"])
    said = F.when(~whole, "insufficient data").otherwise(F.concat_ws("; ", D.delta_text("roll", roll), D.delta_text("tie", tie)))
    return _told(rows, B.ROLL, F.when(whole, _ok(roll) & F.coalesce(_ok(tie), F.lit(True))).otherwise(False), said)


def net_link(wide: DataFrame) -> DataFrame:
    """C3: net income against the cash statement's column of the same duration and period, else of the period if durations do not contradict."""
    kind, period = F.lower(F.coalesce("duration", F.lit(""))), D.period_signature(F.col("column"), F.col("period_end"))["period"]
    known = wide.filter("statement = 'cash'").select(F.col("doc_id").alias("c_doc"), kind.alias("c_kind"), period.alias("c_period"), "col_ord", F.col("cf_net").alias("v"))
    exact = known.groupBy("c_doc", "c_kind", "c_period").agg(F.max_by(F.struct("v"), "col_ord").alias("exact"))
    loose = known.groupBy(F.col("c_doc").alias("l_doc"), F.col("c_period").alias("l_period")).agg(F.max_by(F.struct("v", F.col("c_kind").alias("kind")), "col_ord").alias("loose"))
    rows = wide.filter("statement = 'income'").withColumn("kind", kind).withColumn("period", period)
    rows = rows.join(exact, (F.col("doc_id") == F.col("c_doc")) & (F.col("kind") == F.col("c_kind")) & (F.col("period") == F.col("c_period")), "left")
    rows = rows.join(loose, (F.col("doc_id") == F.col("l_doc")) & (F.col("period") == F.col("l_period")), "left")
    agrees = (F.col("kind") == "") | (F.col("loose.kind") == "") | (F.col("kind") == F.col("loose.kind"))
    rows = rows.withColumn("link", F.when(F.col("exact").isNotNull(), F.col("exact.v")).when(agrees, F.col("loose.v")))
    return _simple(rows, B.NET, ["is_net", "link"], F.col("is_net") - F.col("link"))


def income_cross(wide: DataFrame) -> DataFrame:
    """C4: subtotals of the income statement, as far as a column has their terms; one at least."""
    c = F.col
    parts = [
        ("GP", ["revenue", "cost", "gross"], (c("revenue") + c("cost")) - c("gross")),
        ("OI", ["gross", "opex", "opinc"], (c("gross") - c("opex")) - c("opinc")),
        ("PT", ["opinc", "other", "pretax"], (c("opinc") + c("other")) - c("pretax")),
        ("NI", ["pretax", "tax", "is_net"], (c("pretax") + c("tax")) - c("is_net")),
    ]
    some = reduce(lambda a, b: a | b, [_every(r) for _, r, _ in parts])
    held = reduce(lambda a, b: a & b, [F.when(_every(r), _ok(d)).otherwise(True) for _, r, d in parts])
    said = F.concat_ws(", ", *[F.when(_every(r), D.delta_text(tag, d)) for tag, r, d in parts])
    return _told(wide.filter("statement = 'income'"), B.INCOME, some & held, F.when(some, said).otherwise("insufficient data"))


def certify_documents(facts: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """doc_id, check, result, details: seven checks of every document; ``headers``: doc_id, statement, statement_name, source for the list of pages."""
    wide = written(columns_of(facts), "columns")  # a row for each column of a statement, read by all checks
    c = F.col
    fx = F.coalesce("fx", F.lit(0.0))
    rows = [
        _simple(wide.filter("statement = 'balance'"), B.BALANCE, ["assets", "liabilities", "equity"], c("assets") - (c("liabilities") + c("equity"))),
        cash_roll(wide), net_link(wide), income_cross(wide),
        _simple(wide.filter("statement = 'cash'"), B.CASH, ["cfo", "cfi", "cff", "change"], (c("cfo") + c("cfi") + c("cff") + fx) - c("change")),
    ]
    docs = facts.select("doc_id").distinct()
    order = F.when(c("statement") == "balance", 0).when(c("statement") == "income", 1).otherwise(2)
    pages = docs.select("doc_id", F.lit("").alias("pages"))
    if headers is not None:
        said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.concat("statement_name", F.lit(" "), "source").alias("t")))), lambda x: x["t"]), ", ")
        pages = headers.groupBy("doc_id").agg(said.alias("pages"))
    rows.append(pages.select("doc_id", F.lit(COVERAGE), F.lit("PASS"), F.concat(F.lit("Captured pages: "), "pages", F.lit(". Columns reordered oldest→newest."))))
    rows.append(docs.select("doc_id", F.lit(UNITS), F.lit("PASS"), F.lit(UNITS_TEXT)))
    return reduce(DataFrame.union, rows)
