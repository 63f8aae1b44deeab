"""From injected words to certified tables, workbooks and the command line; one failing document does not stop the rest."""

import json

import pytest
from pyspark.sql import functions as F
from tests.test_files import book

from tallyframe.__main__ import main
from tallyframe.operators import batch, run
from tallyframe.sources import words

YEARS = ["December 31, 2023", "December 31, 2024"]
PAGES = {
    "income": ("CONSOLIDATED STATEMENTS OF OPERATIONS (In millions)", [
        ("Net revenue", 1000, 1200), ("Cost of revenue", 400, 500), ("Gross profit", 600, 700), ("Total operating expenses", 200, 250), ("Operating income", 400, 450),
        ("Interest and other income", 10, 20), ("Income before taxes", 410, 470), ("Provision for income taxes", 110, 120), ("Net income", 300, 350),
    ]),
    "balance": ("CONSOLIDATED BALANCE SHEETS", [("Cash and cash equivalents", 150, 180), ("Total assets", 2000, 2300), ("Total liabilities", 1200, 1300), ("Total stockholders' equity", 800, 1000)]),
    "cash": ("CONSOLIDATED STATEMENTS OF CASH FLOWS", [
        ("Net income", 300, 350), ("Net cash provided by operating activities", 320, 330), ("Net cash used in investing activities", -100, -150), ("Net cash used in financing activities", -170, -150),
        ("Increase (decrease) in cash and cash equivalents", 50, 30), ("Beginning cash and cash equivalents", 100, 150), ("Ending cash and cash equivalents", 150, 180),
    ]),
}


def filing(pages=tuple(PAGES), change=0):
    """Text of a filing: pages end with form feeds; a line's tokens have their left edge before an @."""
    out = ["20@A 40@report"]
    for name in pages:
        title, rows = PAGES[name]
        lines = [" ".join(f"{50 + 60 * i}@{w}" for i, w in enumerate(title.split()))]
        lines += [" ".join(f"{x + 30 * i}@{w}" for x, y in zip((600, 900), YEARS) for i, w in enumerate(y.split()[:2])), " ".join(f"{x}@{y[-4:]}" for x, y in zip((630, 930), YEARS))]
        for label, *values in rows:
            cells = [f"({-v:,})" if v < 0 else f"{v + (change if label == 'Total assets' else 0):,}" for v in values]
            lines.append(" ".join([*(f"{50 + 40 * i}@{w}" for i, w in enumerate(label.split())), *(f"{x}@{c}" for x, c in zip((630, 930), cells))]))
        out.append("\n".join(lines))
    return "\f".join(out)


def edged_words(raw: bytes):
    def page(text):
        def read():
            if "unreadable" in text:
                raise ValueError("unreadable")
            return [(w.partition("@")[2], float(w.partition("@")[0]), float(w.partition("@")[0]) + 20, 15.0 * n) for n, line in enumerate(text.split("\n")) for w in line.split()]

        return read

    return [page(p) for p in raw.decode().split("\f")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("filings")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/good.pdf").write_text(filing())
    (tmp_path / "in/off.pdf").write_text(filing(change=7))
    (tmp_path / "in/half.pdf").write_text(filing(["income", "balance"]))
    (tmp_path / "in/torn.pdf").write_text(filing() + "\f1@unreadable")
    return tmp_path


@pytest.fixture(scope="module")
def out(spark, folder):
    spark.dataSource.register(words.word_source(edged_words, "edged"))
    read = spark.read.format("edged")
    return run.extract_reports(read.load(f"{folder}/in"), unread=read.option("rows", "errors").load(f"{folder}/in"))


def test_words_to_certification(out):
    names = F.substring_index("doc_id", "/", -1).alias("doc")
    assert {(r.doc, r.step, r.error) for r in out.errors.select(names, "step", "error").collect()} == {("half.pdf", "pages", "no page of: cash"), ("torn.pdf", "words", "page 5: ValueError: unreadable")}
    values = {(r.doc, r.statement, r.label, r.col_ord): r.value for r in out.facts.select(names, "statement", "label", "col_ord", "value").collect()}
    assert {k[0] for k in values} == {"good.pdf", "off.pdf", "torn.pdf"} and len(values) == 3 * 2 * sum(len(rows) for _, rows in PAGES.values())
    assert values["good.pdf", "income", "Cost of revenue", 1] == -500 and values["good.pdf", "cash", "Net cash used in investing activities", 0] == -100 and values["off.pdf", "balance", "Total assets", 0] == 2007
    blocks = {(r.doc, r.statement): (r.title, r.scale, r.source) for r in out.blocks.select(names, "statement", "title", "scale", "source").collect()}
    assert blocks["good.pdf", "income"] == ("CONSOLIDATED STATEMENTS OF OPERATIONS", 1.0, "p.2") and blocks["torn.pdf", "cash"][2] == "p.4" and len(blocks) == 9
    checks = {}
    for r in out.checks.select(names, "check", "result").collect():
        checks.setdefault(r.doc, {})[r.check] = r.result
    assert set(checks["good.pdf"].values()) == {"PASS"} and len(checks["good.pdf"]) == 7
    assert [c for c, v in checks["off.pdf"].items() if v == "CHECK"] == [batch.BALANCE]
    # the batch takes the last document that tells a value: torn.pdf comes after off.pdf
    assert {r["Result"] for r in out.batch_checks.collect()} <= {"PASS", "CHECK"} and out.batch_checks.count() == 5
    table = run.long_table(out)
    assert len(table.columns) == 12 and table.count() == len(values)


def test_outputs_and_restart(spark, folder, out):
    run.write_reports(out, f"{folder}/out", f"{folder}/books")
    assert sorted(p.name for p in (folder / "books").iterdir()) == ["good_tables.xlsx", "off_tables.xlsx", "torn_tables.xlsx"]
    sheets = book(folder / "books/good_tables.xlsx")
    assert sheets["WIDE_Income"][0] == ["Statement Name", "CONSOLIDATED STATEMENTS OF OPERATIONS"] and sheets["WIDE_Income"][-1] == [9.0, 0.0, "Net income", 300.0, 350.0] and len(sheets["Certification"]) == 8
    assert spark.read.parquet(f"{folder}/out/long_all").count() == run.long_table(out).count() and spark.read.parquet(f"{folder}/out/errors").count() == 2
    done = spark.createDataFrame([("good",), ("off",), ("torn",)], "name string")
    left = run.pending(spark.read.format("edged").load(f"{folder}/in"), done)
    assert {r[0] for r in left.select(run.document_name("doc_id")).distinct().collect()} == {"half"}
    frames, issues = run.series_tables(out.facts)
    assert frames.filter("line = 'Net income' and statement = 'income' and column = 'FY 2024'").first().value == 350 and issues.count() == 0


def test_no_documents(spark):
    none = spark.createDataFrame([], words.WORDS)
    out = run.extract_reports(none)
    assert out.facts.count() == out.checks.count() == out.batch_checks.count() == out.errors.count() == 0


def test_command_line(spark, folder, capsys):
    assert main(["extract", "--batch", f"{folder}/in", "--backend", "tests.test_run:edged_words", "--output", f"{folder}/cli", "--per-file", "--per-file-dir", f"{folder}/cli-books"]) == 0
    said = capsys.readouterr().out
    assert "half.pdf" in said and "off.pdf" in said and len(list((folder / "cli-books").iterdir())) == 3
    assert main(["extract", f"{folder}/in/half.pdf", "--backend", "tests.test_run:edged_words", "--output", f"{folder}/one"]) == 1
    assert main(["plan", "--latest", "Q1 2026", "--years", "2", "--json"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["required_fiscal_years"] == ["FY 2024", "FY 2025"]
    assert main(["plan", "--latest", "FY2024", "--years", "3"]) == 0
    assert capsys.readouterr().out.split("\n")[:3] == ["10-K 2024", "10-K 2022", "10-Q 2024 Q2"]
    with pytest.raises(SystemExit):
        main(["extract", "--output", "x"])
    assert main(["plan", "--latest", "2025Q3"]) == 1
