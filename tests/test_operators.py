"""Expressions, sources, sinks, review and streaming by hand."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import labels, numbers
from tallyframe.operators import planner, review
from tallyframe.sources import readers, sinks


def test_numbers(spark):
    cells = ["1,234", "(1,234)", "(1,234", "—", "", "4.71", None]
    rows = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in rows.select(numbers.parse_number(F.col("c"))).collect()] == [1234.0, -1234.0, None, None, None, 4.71, None]


def test_labels(spark):
    rows = spark.createDataFrame([("Total  assets:",), ("Issued, respectively",), ("12",), (None,)], "c string")
    got = rows.select(labels.canonical(F.col("c")).alias("c"), labels.suspicions(F.col("c")).alias("s")).collect()
    assert got[0].c == "Total assets" and got[2].s == ["contains_digits", "non_text_label"] and got[3].s == ["missing_label"]


def test_planner(spark):
    assert planner.plan(spark, "Q1 2026", 10).count() == 16
    assert planner.plan(spark, "FY2024", 3).count() == 6
    for bad in ("2025Q3", "Q5 2024", ""):
        with pytest.raises(planner.PeriodError):
            planner.parse_period(bad)
    with pytest.raises(ValueError):
        planner.plan(spark, "FY2024", 0)


def test_review_survives_a_failing_client(spark):
    def client(request):
        raise OSError

    asked = spark.createDataFrame([(1, '{"label": "x"}')], "id int, request string")
    replies = review.reviewed(asked, ["id"], client, attempts=2, delay=0.0)
    assert replies.collect()[0].reply is None and review.suggestions(replies, ["id"]).count() == 0


def test_pages_and_aliases(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\fTotal   assets")
    pages = readers.page_texts(readers.document_files(spark, str(tmp_path)), lambda raw: raw.decode().split("\f"))
    assert [(r.page_idx, r.text) for r in pages.orderBy("page_idx").collect()] == [(0, "one"), (1, "Total assets")]
    (tmp_path / "rules.txt").write_text("# rules\nincome:\n  Net sales: Revenue\n  net sales: Net revenue\nbalance:\n  Cash: Cash\n")
    got = {(r.statement, r.key): r.value for r in readers.aliases(spark, str(tmp_path / "rules.txt")).collect()}
    assert got == {("income", "net sales"): "Net revenue", ("balance", "cash"): "Cash"}


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    sinks.write_long(df, df.limit(1), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/long_all")).count() == 3
    sinks.write_log(df.filter("id < 0"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
