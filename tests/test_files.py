"""Word source and whole-file sinks: page ranges, bad pages, workbooks read back, commits and aborts."""

import zipfile
from pathlib import Path
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tallyframe.sources import stores, words, workbooks

NS = {"x": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def text_words(raw: bytes):
    """Pages end with form feeds, lines with newlines; a page with "bad" cannot be read, nor a file that starts with "!"."""
    if raw.startswith(b"!"):
        raise OSError("damaged")

    def page(text):
        def read():
            if "bad" in text:
                raise ValueError("bad page")
            return [(w, 10.0 * i, 10.0 * i + 5, 12.0 * n) for n, line in enumerate(text.split("\n")) for i, w in enumerate(line.split())]

        return read

    return [page(p) for p in raw.decode().split("\f")]


def book(path):
    """Rows of every sheet of a workbook; numbers as floats, empty cells as None."""
    with zipfile.ZipFile(path) as z:
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("x:sheets", NS)]
        out = {}
        for i, name in enumerate(names, 1):
            rows = []
            for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{{{NS['x']}}}row"):
                cells = []
                for c in r:
                    text, number = c.find("x:is/x:t", NS), c.find("x:v", NS)
                    cells.append(text.text or "" if text is not None else float(number.text) if number is not None else None)
                rows.append(cells)
            out[name] = rows
        assert len(ElementTree.fromstring(z.read("[Content_Types].xml"))) == len(names) + 2
        return out


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.pdf").write_text("one two\nthree\fbad\ffour")
    (tmp_path / "in/deep/b.pdf").write_text("\f".join(f"page {i}" for i in range(50)))
    (tmp_path / "in/c.pdf").write_text("!x")
    (tmp_path / "in/d.txt").write_text("no")
    (tmp_path / "in/e.pdf").write_text("")
    return tmp_path


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_word_source(spark, folder, size):
    spark.dataSource.register(words.word_source(text_words, "some_words"))
    read = spark.read.format("some_words").option("partitionBytes", size)
    df = read.load(f"{folder}/in")
    assert df.dtypes == [("doc_id", "string"), ("page_idx", "int"), ("text", "string"), ("x0", "double"), ("x1", "double"), ("top", "double")]
    rows = [(Path(r.doc_id).name, r.page_idx, r.text, r.x0, r.x1, r.top) for r in df.collect()]
    assert sorted(r for r in rows if r[0] == "a.pdf") == [("a.pdf", 0, "one", 0.0, 5.0, 0.0), ("a.pdf", 0, "three", 0.0, 5.0, 12.0), ("a.pdf", 0, "two", 10.0, 15.0, 0.0), ("a.pdf", 2, "four", 0.0, 5.0, 0.0)]
    assert sorted(r[1:3] for r in rows if r[0] == "b.pdf" and r[2] != "page") == [(i, str(i)) for i in range(50)] and len(rows) == 104
    bad = {(Path(r.doc_id).name, r.page_idx, r.error) for r in read.option("rows", "errors").load(f"{folder}/in").collect()}
    assert bad == {("a.pdf", 1, "ValueError: bad page"), ("c.pdf", None, "OSError: damaged")}
    assert {Path(r.doc_id).name for r in read.option("rows", "words").option("recursive", "false").load(f"{folder}/in").collect()} == {"a.pdf"}
    assert read.option("pattern", "d.*").load(f"{folder}/in").count() == 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(f"{folder}/in")
    assert sorted((Path(r.doc_id).name, *r[1:]) for r in words.words(files, text_words).collect()) == sorted(rows)
    assert words.words(files, text_words, errors=True).count() == 2


def test_word_source_options(spark, folder):
    spark.dataSource.register(words.WordSource)
    read = spark.read.format("tallyframe_words")
    with pytest.raises(Exception, match="rows must be"):
        read.option("rows", "other").load(f"{folder}/in")
    named = spark.read.format("tallyframe_words").option("backend", "tests.test_files:text_words").load(f"{folder}/in/a.pdf")
    assert named.count() == 4
    assert spark.read.format("tallyframe_words").option("rows", "errors").load(f"{folder}/in/a.pdf").filter(F.contains("error", F.lit("pdfplumber"))).count() <= 1


def test_packing():
    parts = words.packed([("a", 10), ("b", 25), ("c", 5), ("d", 5), ("e", 0)], 10)
    assert [p.parts for p in parts] == [[("a", 0, 1)], [("b", 0, 3)], [("b", 1, 3)], [("b", 2, 3)], [("c", 0, 1), ("d", 0, 1), ("e", 0, 1)]] and words.packed([], 10) == []


FACTS = "doc_id string, statement string, order_index int, level int, label string, col_ord int, column string, value double"
BLOCKS = "doc_id string, statement string, title string, original_units string, scale double, units_assumption string, audited string, source string"


def test_workbooks(spark, tmp_path):
    facts = [("d/1", "income", i, 0, f"line <{i}> & \x01", c, name, None if (i, c) == (2, 0) else 1.5 * i + c) for i in (1, 2, 10) for c, name in enumerate(["FY 2025", "FY 2024"])]
    facts += [("d/1", "cash", 1, 1, "Cash", 0, "2024", float("nan")), ("e", "income", 1, 0, "Sales", 0, "x", 3.0)]
    blocks = [("d/1", "income", "STATEMENTS", "In millions", 1.0, None, "Unaudited", "p.1"), ("e", "income", "T", "Unspecified", 1.0, "Assumed dollars", "A", "p.2, p.3")]
    checks = spark.createDataFrame([("d/1", "identity", "PASS", ""), ("d/1", "other", "CHECK", "Δ 1")], "doc_id string, check string, result string, details string")
    rows = workbooks.document_sheets(spark.createDataFrame(facts, FACTS).repartition(3), spark.createDataFrame(blocks, BLOCKS), checks)
    workbooks.write_workbooks(rows, f"{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["d_1.xlsx", "e.xlsx"]
    one, two = book(tmp_path / "out/d_1.xlsx"), book(tmp_path / "out/e.xlsx")
    assert list(one) == list(two) == ["WIDE_Income", "WIDE_BalanceSheet", "WIDE_CashFlows", "LONG_All", "Certification"]
    assert one["WIDE_Income"] == [
        ["Statement Name", "STATEMENTS"], ["Original Units", "In millions"], ["Saved Units", "USD millions (normalized)"], ["Audited/Unaudited", "Unaudited"], ["Source (page number[s])", "p.1"], [],
        ["Order Index", "Level", "Line Item (as printed)", "FY 2024", "FY 2025"], [1.0, 0.0, "line <1> & ", 2.5, 1.5], [2.0, 0.0, "line <2> & ", 4.0, None], [10.0, 0.0, "line <10> & ", 16.0, 15.0],
    ]
    assert one["WIDE_CashFlows"] == [[], ["Order Index", "Level", "Line Item (as printed)", "2024"], [1.0, 1.0, "Cash", None]] and one["WIDE_BalanceSheet"] == [[]]
    assert two["WIDE_Income"][5] == ["Units Assumption", "Assumed dollars"] and two["Certification"] == [["Check", "Result", "Details"]]
    assert len(one["LONG_All"]) == 8 and one["LONG_All"][1] == ["STATEMENTS", 1.0, 0.0, "line <1> & ", "FY 2025", 1.5, "In millions", "USD millions (normalized)", "", "Unaudited", "p.1"]
    assert sorted(one["Certification"][1:]) == [["identity", "PASS", ""], ["other", "CHECK", "Δ 1"]]
    workbooks.write_workbooks(rows.filter("name = 'e'"), f"{tmp_path}/out", "overwrite")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["e.xlsx"]


def test_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(workbooks.WorkbookSink)
    fails = spark.range(20).repartition(4).selectExpr("concat('doc', id) name", "0 sheet_no", "'s' sheet", "named_struct('a', 0L, 'b', 0L, 'c', 0L) at", "array(named_struct('s', if(id = 13, raise_error('killed'), 'x'), 'n', cast(null as double))) cells")
    with pytest.raises(Exception, match="killed"):
        workbooks.write_workbooks(fails, f"{tmp_path}/out")
    assert list((tmp_path / "out").rglob("*")) == [] if (tmp_path / "out").exists() else True
    twice = spark.createDataFrame([("a", b"1"), ("a", b"2")], "name string, content binary").repartition(2)
    with pytest.raises(Exception, match="several documents"):
        workbooks.write_files(twice, f"{tmp_path}/files", ".txt")
    assert not list((tmp_path / "files").rglob("*.txt"))


def test_subsets(spark, folder):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(f"{folder}/in")
    chosen = files.selectExpr("path doc_id", "explode(array(2, 0, 2, 70, -1)) page_idx").filter("doc_id like '%/a.pdf' or doc_id like '%/b.pdf'")
    workbooks.write_files(workbooks.subsets(files, chosen, workbooks.text_subset), f"{folder}/out", " - FS only (robust).txt")
    assert {p.name: p.read_bytes() for p in (folder / "out").iterdir()} == {"a - FS only (robust).txt": b"one two\nthree\ffour", "b - FS only (robust).txt": b"page 0\fpage 2"}


def test_series_workbook(spark, tmp_path):
    frames = [("all", "income", 1, 0, "Sales", (2024, 1), "Q1", 1.0), ("all", "income", 1, 0, "Sales", (2024, 2), "Q2", None), ("all", "income", 2, 1, "Costs", (2024, 2), "Q2", -2.0)]
    rows = workbooks.series_sheets(
        spark.createDataFrame(frames, "name string, statement string, order_index int, level int, line string, position struct<y: int, n: int>, column string, value double"),
        spark.createDataFrame([("all", "cash", "x", "quarter-index", "Q1", "d")], "name string, statement string, line string, issue string, period string, detail string"), "name",
    )
    workbooks.write_workbooks(rows, f"{tmp_path}/s")
    got = book(tmp_path / "s/all.xlsx")
    assert got == {"TimeSeries_Income": [["Level", "Line Item", "Q1", "Q2"], [0.0, "Sales", 1.0, None], [1.0, "Costs", None, -2.0]], "Diagnostics": [["Statement", "Line Item", "Issue", "Period", "Detail"], ["cash", "x", "quarter-index", "Q1", "d"]]}


def test_listing(tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"123")
    assert stores.listed(f"{tmp_path}", "*.pdf", True) == [(f"{tmp_path}/x.pdf", 3)] and stores.listed(f"file://{tmp_path}/x.pdf", "*.pdf", True)[0][1] == 3
    with pytest.raises(FileNotFoundError):
        stores.listed(f"{tmp_path}/none", "*", True)
