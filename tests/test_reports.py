"""Label rules, extraction from words and page selection by hand."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import describe as D
from tallyframe.functions import lines as N
from tallyframe.functions import rewrites as W
from tallyframe.operators import extract, review, select


def values(spark, given, use):
    df = spark.createDataFrame(list(enumerate(given)), "i int, x string").select("i", use(F.col("x")).alias("y"))
    return [r.y for r in sorted(df.collect(), key=lambda r: r.i)]


def test_line_rules(spark):
    skipped = ["", "12/31/2024", "Table of Contents", "see https://x", "Page 4", "Year ended March 31,", "CONSOLIDATED STATEMENTS OF CASH FLOWS", "ea-1234:9", "Some Document 10:45"]
    assert all(values(spark, skipped, N.skipped_line)) and not any(values(spark, ["Net revenue 7,562", "Cost of revenue"], N.skipped_line))
    assert values(spark, ["", "(1)", "a", "12b", "—", "ab", "4.71"], N.footnote_token) == [True, True, True, True, True, False, False]
    assert values(spark, ["-", "–", "$7", "(x)", "abc", "()"], N.numeric_token) == [True, True, True, True, False, True]
    assert values(spark, ["$ (1,234)", "12%", "—"], N.clean_number) == ["(1,234)", "12", "-"]


def test_period_labels(spark):
    given = ["For the three months ended March 31, 2024", "(In millions) 2024", "Nine months ended Year ended December 31, 2023", "Revenue", "Six  months ended June 30, 2024 2023"]
    assert values(spark, given, N.clean_period) == ["three months ended March 31, 2024", "2024", "Year ended December 31, 2023", "Revenue", "Six months ended June 30, 2024"]
    raw = "Three Months Ended Six Months Ended June 30, 2024"
    four = [values(spark, [raw], lambda x, i=i: N.column_label(x, F.lit(i), F.lit(4)))[0] for i in range(4)]
    assert four == ["Three Months Ended June 30, 2024"] * 2 + ["Six Months Ended June 30, 2024"] * 2
    merged = spark.createDataFrame([(["March 31,", "2024", "2025", "2023"],)], "x array<string>").select(N.merged_fragments(F.col("x")).alias("y")).first().y
    assert merged == ["March 31, 2024", "2025", "2023"]
    assert extract.column_centres([1.0, 3.0, 10.0, 12.0], 2) == [2.0, 11.0] and extract.column_centres([5.0], 2) == [5.0, 5.0]
    assert values(spark, ["1234567", "0.05", "8604", "0", "-0.00012345678", "100000"], lambda x: D.significant(x.cast("double"))) == [f"{v:.6g}" for v in (1234567, 0.05, 8604, 0, -0.00012345678, 100000)]


def test_label_clean_up(spark):
    given = {
        "Receivables, net (1)": "Receivables, net",
        "Allowance, respectively": "Allowance",
        "Total assets LIABILITIES AND EQUITY": "Total assets",
        "Common stock, shares issued 12": "Common stock",
        "Weighted shares outstanding": "Shares outstanding",
        "Property and equipment, net of the": "Property and equipment, net",
        "See the accompanying notes": "",
        "(in thousands) x": "",
        "Net income attributable to Amk": "Net income attributable to Amkor",
        "Retained earnings": "Retained earnings (accumulated deficit)",
        None: "",
    }
    assert values(spark, list(given), lambda x: W.clean_label(F.coalesce(x, F.lit("")))) == list(given.values())
    names = {"Net income (loss)": "Net income", "Income before taxes": "Income before income taxes", "Amounts": "", "Other, net": "Other, net", "Inventories": "Inventories"}
    assert values(spark, list(names), lambda x: W.canonical_name(x, x)) == list(names.values())
    shares = spark.createDataFrame([("Basic", [4.7]), ("Basic", [280.0]), ("Diluted", [None]), ("Cash", [1.0])], "l string, v array<double>")
    assert [r[0] for r in shares.select(W.per_share_name(F.col("l"), F.col("v"))).collect()] == ["Earnings per share - Basic", "Shares used - Basic", "Shares used - Diluted", "Cash"]


def words(rows, doc="d", statement="balance"):
    return [(doc, statement, 0, w, x + 30.0 * k, x + 30.0 * k + 25.0, 20.0 * i) for i, row in enumerate(rows) for x, text in row for k, w in enumerate(text.split(" "))]


def test_extraction(spark):
    page = [
        [(300, "March 31,"), (400, "March 31,")], [(320, "2024"), (420, "2025")], [(50, "ASSETS")], [(50, "Cash and cash equivalents (1)"), (320, "1,000"), (420, "2,000")],
        [(60, "Deferred income")], [(320, "(30)"), (420, "—")], [(320, "5"), (420, "6")], [(60, "Goodwill")], [(50, "Total assets"), (320, "$ 970"), (420, "2,006")], [(50, "See accompanying notes")],
    ]
    df = spark.createDataFrame(words(page) + words(page, "e") + words([[(50, "no columns here")]], "f"), "doc_id string, statement string, page_idx int, text string, x0 double, x1 double, top double")
    got = sorted((r.order_index, r.col_ord, r.label, r.column, r.value) for r in extract.table_rows(df, ["doc_id", "statement"]).filter("doc_id = 'd'").collect())
    rows = [(label, v) for _, c, label, _, v in got if c == 0]
    assert ("Cash and cash equivalents", 1000.0) in rows and ("Deferred income", -30.0) in rows and ("Total assets", 970.0) in rows and ("Goodwill", 5.0) in rows
    assert {c for *_, c, _ in got} == {"March 31, 2024", "March 31, 2025"}
    kept, lacks = extract.complete_documents(extract.table_rows(df, ["doc_id", "statement"]), "doc_id")
    assert kept.count() == 0 and {r.doc_id for r in lacks.collect()} == {"d", "e"}


def test_dashes_units_and_blocks(spark):
    """A row of dashes has no value, so the next line joins its label; a line of units ends waiting; units, title and pages of a statement."""
    page = [
        [(50, "CONSOLIDATED STATEMENTS OF INCOME (unaudited)")], [(320, "2024"), (420, "2025")], [(50, "Net revenue"), (320, "5,000"), (420, "6,000")], [(50, "Goodwill"), (320, "—"), (420, "—")],
        [(50, "related party")], [(50, "Gains")], [(50, "(In millions) 7")], [(320, "1"), (420, "2")], [(50, "Total gains"), (320, "9"), (420, "8")],
    ]
    df = spark.createDataFrame(words(page, statement="income") + [("d", "income", 3, "tail", 1.0, 2.0, 3.0)], "doc_id string, statement string, page_idx int, text string, x0 double, x1 double, top double")
    block = extract.statement_blocks(df, ["doc_id", "statement"]).first()
    assert (block.title, block.original_units, block.scale, block.audited, block.source) == ("CONSOLIDATED STATEMENTS OF INCOME", "In millions", 1.0, "Unaudited", "p.1, p.4")
    got = [(r.label, r.value) for r in sorted(extract.table_rows(df, ["doc_id", "statement"]).filter("col_ord = 1").collect(), key=lambda r: r.order_index)]
    assert got == [("Net revenue", 6000.0), ("Goodwill related party Gains", None), ("Total gains", 8.0), ("tail", None)]
    small = spark.createDataFrame(words([[(50, "(In thousands)")], *page[1:3]]), df.schema)
    assert [r.value for r in extract.table_rows(small, ["doc_id", "statement"]).orderBy("col_ord").collect()] == [5.0, 6.0]
    plain = spark.createDataFrame([("cash", "a\nb"), ("balance", "Consolidated  Balance Sheet"), ("income", "x\r\n CONSOLIDATED STATEMENT OF EARNINGS\n"), ("income", "CONSOLIDATED STATEMENTS OF OPERATIONS AND COMPREHENSIVE INCOME"), ("other", "x")], "s string, t string")
    titles = [r[0] for r in plain.select(N.statement_title(F.col("s"), F.col("t"))).collect()]
    assert titles == ["CONSOLIDATED STATEMENTS OF CASH FLOWS", "CONSOLIDATED BALANCE SHEETS", "CONSOLIDATED STATEMENT OF EARNINGS", "CONSOLIDATED STATEMENTS OF OPERATIONS", None]


def test_selection_fallbacks(spark):
    money, anchors = "\n1,234 2,345 3,456 4,567 5,678 6,789", "\ntotal assets total liabilities accounts receivable deferred revenue"
    pages = [("x", i, "CONSOLIDATED BALANCE SHEETS" + anchors + money if i in (6, 9) else "prose") for i in range(12)]
    df = spark.createDataFrame(pages, "doc_id string, page_idx int, text string")
    flags = select.flagged(df)
    assert [(r.statement, r.page_idx) for r in select.select_pages(df).collect()] == [("balance", 6)]
    none = select.select_pages(df).filter("false")
    assert [(r.statement, r.page_idx) for r in select.first_hits(flags, none).collect()] == [("balance", 6)]
    assert sorted(r.page_idx for r in select.median_window(flags, df).collect()) == list(range(5, 12))


def test_suggestions_are_applied(spark):
    rows = spark.createDataFrame([("income", 1, "Reveneu", ["x"]), ("income", 2, "Total", None), ("cash", 1, "Cash", None)], "statement string, row_index int, label string, reasons array<string>")
    given = spark.createDataFrame([("income", 1, "Revenue"), ("income", 2, "Sum"), ("cash", 9, "None")], "statement string, row_index int, label string")
    got = {(r.statement, r.row_index): (r.label, r.reasons) for r in review.applied(rows, given, ["statement", "row_index"]).collect()}
    assert got == {("income", 1): ("Revenue", ["x", "llm_normalized"]), ("income", 2): ("Total", None), ("cash", 1): ("Cash", None)}
    assert review.asked_wait("please try again in 2.5s") == 2.5 and review.asked_wait("no") is None


@pytest.mark.parametrize("text", ["audited by", "Unaudited"])
def test_audited(spark, text):
    assert values(spark, [text], N.audited) == ["Unaudited" if text == "Unaudited" else "Audited"]
