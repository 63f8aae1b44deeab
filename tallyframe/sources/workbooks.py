"""Workbooks and other whole files as Spark sinks: one file a document.

Rows of sheets are made by DataFrame operations; a document's rows come to one task in order, which streams
them into one file (a zip of XML parts), so a task holds a row at a time. Files appear at their
place when the whole job commits.
"""

from __future__ import annotations

import math
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from tallyframe.sources.stores import Made, WholeFileWriter

# Sheets by statement, the header block's keys, and the columns of each kind of sheet.
WIDE_SHEETS = {"income": "WIDE_Income", "balance": "WIDE_BalanceSheet", "cash": "WIDE_CashFlows"}
SERIES_SHEETS = {"income": "TimeSeries_Income", "balance": "TimeSeries_BalanceSheet", "cash": "TimeSeries_CashFlows"}
LONG_SHEET, CHECK_SHEET, ISSUE_SHEET = "LONG_All", "Certification", "Diagnostics"
SAVED_UNITS = "USD millions (normalized)"
HEADER = {"Statement Name": "title", "Original Units": "original_units", "Saved Units": "saved_units", "Audited/Unaudited": "audited", "Source (page number[s])": "source", "Units Assumption": "units_assumption"}
WIDE = ["Order Index", "Level", "Line Item (as printed)"]
LONG = ["Statement", *WIDE, "Column Header (as printed)", "Value (in millions)", "Original Units", "Saved Units", "Units Assumption", "Audited/Unaudited", "Page"]
CHECKS = ["Check", "Result", "Details"]
ISSUES = ["Statement", "Line Item", "Issue", "Period", "Detail"]
SCHEMA = "name string, sheet_no int, sheet string, at struct<a: long, b: long, c: long>, cells array<struct<s: string, n: double>>"
#: Characters that XML does not allow.
_BAD = {c: None for c in [*range(9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF]}
_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _cell(c: Row | None) -> str:
    if c is None or (c["s"] is None and (c["n"] is None or math.isnan(c["n"]) or math.isinf(c["n"]))):
        return "<c/>"
    if c["s"] is None:
        n = c["n"]
        return f"<c><v>{int(n) if n == int(n) and abs(n) < 1e15 else repr(n)}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c["s"].translate(_BAD))}</t></is></c>'


class _Workbook:
    """A workbook that is written sheet by sheet, row by row."""

    def __init__(self, out) -> None:
        self.zip, self.sheets, self.part = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), [], None

    def row(self, sheet: str, cells: list[Row]) -> None:
        if not self.sheets or self.sheets[-1] != sheet:
            self._end()
            self.sheets.append(sheet)
            self.part = self.zip.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w")
            self._put(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_NS}"><sheetData>')
        self._put(f"<row>{''.join(map(_cell, cells or []))}</row>")

    def _put(self, text: str) -> None:
        self.part.write(text.encode("utf-8", "replace"))

    def _end(self) -> None:
        if self.part:
            self._put("</sheetData></worksheet>")
            self.part.close()

    def close(self) -> None:
        self._end()
        many = range(1, len(self.sheets) + 1)
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in many)
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{types}</Types>',
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{_NS}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(many, self.sheets)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in many) + "</Relationships>",
        }
        for name, text in parts.items():
            self.zip.writestr(name, head + text)
        self.zip.close()


class WorkbookWriter(WholeFileWriter):
    """Rows in order of name, sheet and place; a file for each name."""

    def write(self, iterator: Iterator[Row]) -> Made:
        made, row = Made(), next(iterator, None)
        while row is not None:
            name = row["name"]
            with self.file(name, made) as out:
                book = _Workbook(out)
                while row is not None and row["name"] == name:
                    book.row(row["sheet"], row["cells"])
                    row = next(iterator, None)
                book.close()
        return made


class FileWriter(WholeFileWriter):
    """Rows of name and content; a file for each."""

    def write(self, iterator: Iterator[Row]) -> Made:
        made = Made()
        for row in iterator:
            with self.file(row["name"], made) as out:
                out.write(bytes(row["content"] or b""))
        return made


class WorkbookSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tallyframe_workbooks"

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], ".xlsx", overwrite)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tallyframe_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], self.options.get("suffix", ""), overwrite)


def _value(c: Column, text: bool) -> Column:
    none = F.lit(None)
    return F.struct((c.cast("string") if text else none.cast("string")).alias("s"), (none.cast("double") if text else c.cast("double")).alias("n"))


def _titles(names: list[str]) -> Column:
    return F.array(*[_value(F.lit(n), True) for n in names])


def _rows(df: DataFrame, name: Column, number: int, sheet: str, at: list[Column | int], cells: Column) -> DataFrame:
    place = F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast("long").alias(n) for x, n in zip([*at, 0, 0, 0], "abc")])
    return df.select(name.cast("string").alias("name"), F.lit(number).alias("sheet_no"), F.lit(sheet).alias("sheet"), place.alias("at"), cells.alias("cells"))


def period_order(column: Column, at: Column) -> Column:
    """What columns of periods are ordered by: the first four digits in a row of their name, the name, their place."""
    year = F.regexp_extract(column, r"\d{4}", 0)
    return F.struct(F.when(year == "", 9999).otherwise(year.cast("int")).alias("year"), F.btrim(column).alias("name"), at.alias("at"), column.alias("column"))


def statement_sheets(facts: DataFrame, blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows of the three wide sheets of every document: header block, an empty row, titles, lines by order.

    facts: doc, statement, order_index, level, label, col_ord, column, value. blocks: doc, statement and what a header holds. A line's
    columns are put in the order of periods; a cell that a line lacks is empty. All documents have all sheets.
    """
    name = F.col(doc)
    parts = []
    for i, (statement, sheet) in enumerate(WIDE_SHEETS.items()):
        own = facts.filter(F.col("statement") == statement)
        head = blocks.filter(F.col("statement") == statement)
        pairs = F.array(*[F.struct(F.lit(n).alias("row"), F.lit(k).alias("k"), (F.col(c) if c in blocks.columns else F.lit(SAVED_UNITS)).cast("string").alias("v")) for n, (k, c) in enumerate(HEADER.items())])
        given = head.withColumn("_p", F.explode(F.filter(pairs, lambda p: (p["k"] != "Units Assumption") | (F.coalesce(p["v"], F.lit("")) != ""))))
        parts.append(_rows(given, name, i, sheet, [0, F.col("_p.row")], F.array(_value(F.col("_p.k"), True), _value(F.col("_p.v"), True))))
        parts.append(_rows(facts.select(doc).union(blocks.select(doc)).distinct(), name, i, sheet, [1], F.array().cast("array<struct<s: string, n: double>>")))
        order = own.groupBy(F.col(doc).alias("_doc")).agg(F.array_sort(F.collect_set(period_order(F.col("column"), F.col("col_ord")))).alias("_order"))
        parts.append(_rows(order, F.col("_doc"), i, sheet, [2], F.concat(_titles(WIDE), F.transform("_order", lambda o: _value(o["column"], True)))))
        lines = own.groupBy(doc, "order_index").agg(F.first("level").alias("level"), F.first("label").alias("label"), F.map_from_entries(F.collect_list(F.struct("col_ord", "value"))).alias("_cells"))
        met = lines.join(order, F.col(doc) == F.col("_doc"))
        cells = F.concat(F.array(_value(F.col("order_index"), False), _value(F.col("level"), False), _value(F.col("label"), True)), F.transform("_order", lambda o: _value(F.try_element_at("_cells", o["at"]), False)))
        parts.append(_rows(met, name, i, sheet, [3, F.col("order_index")], cells))
    return reduce(DataFrame.unionAll, parts)


def table_sheet(df: DataFrame, name: Column, number: int, sheet: str, titles: list[str], order: list[Column], names: DataFrame | None = None) -> DataFrame:
    """Rows of a plain table: titles, then the columns of those names. ``names``: documents (name) that get the sheet even without rows."""
    kinds = dict(df.dtypes)
    body = _rows(df, name, number, sheet, [1, *order], F.array(*[_value(F.col(f"`{t}`"), kinds[t] == "string") for t in titles]))
    known = df.select(name.cast("string").alias("name")) if names is None else names.select(F.col("name").cast("string").alias("name"))
    return _rows(known.distinct(), F.col("name"), number, sheet, [0], _titles(titles)).unionAll(body)


def document_sheets(facts: DataFrame, blocks: DataFrame, checks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows of a workbook a document: three wide statements, LONG_All and Certification.

    checks: doc, check, result, details.
    """
    names = facts.select(F.col(doc).alias("name")).union(blocks.select(F.col(doc).alias("name"))).distinct()
    b = blocks.select(*[F.col(c).alias(f"b_{c}") for c in blocks.columns])
    long_ = facts.join(b, (F.col(doc) == F.col(f"b_{doc}")) & (F.col("statement") == F.col("b_statement")), "left")
    columns = [F.coalesce(F.col("b_title"), F.col("statement")), F.col("order_index"), F.col("level"), F.col("label"), F.col("column"), F.col("value").cast("double"), F.col("b_original_units"), F.lit(SAVED_UNITS), F.coalesce(F.col("b_units_assumption"), F.lit("")), F.col("b_audited"), F.col("b_source")]
    kind = F.array_position(F.array(*map(F.lit, WIDE_SHEETS)), F.col("statement"))
    table = long_.select(F.col(doc).alias("_name"), kind.alias("_kind"), F.col("order_index").alias("_order"), F.col("col_ord").alias("_at"), *[c.alias(t) for c, t in zip(columns, LONG, strict=True)])
    told = checks.select(F.col(doc).alias("_name"), F.col("check").alias("Check"), F.col("result").alias("Result"), F.col("details").alias("Details"))
    return (
        statement_sheets(facts, blocks, doc)
        .unionAll(table_sheet(table, F.col("_name"), 3, LONG_SHEET, LONG, [F.col("_kind"), F.col("_order") * 1000 + F.col("_at")], names))
        .unionAll(table_sheet(told, F.col("_name"), 4, CHECK_SHEET, CHECKS, [F.xxhash64("Check")], names))
    )


def series_sheets(frames: DataFrame, issues: DataFrame, name: str) -> DataFrame:
    """Rows of a workbook of fiscal series for each value of ``name``: a sheet for each statement that has any, and Diagnostics.

    frames: name, statement, order_index, level, line, position (struct, orders the columns), column, value. issues: name, statement, line, issue, period, detail.
    """
    parts = []
    for i, (statement, sheet) in enumerate(SERIES_SHEETS.items()):
        own = frames.filter(F.col("statement") == statement)
        order = own.groupBy(F.col(name).alias("_name")).agg(F.array_sort(F.collect_set(F.struct("position", "column"))).alias("_order"))
        parts.append(_rows(order, F.col("_name"), i, sheet, [0], F.concat(_titles(["Level", "Line Item"]), F.transform("_order", lambda o: _value(o["column"], True)))))
        lines = own.groupBy(name, "order_index", "level", "line").agg(F.map_from_entries(F.collect_list(F.struct("position", "value"))).alias("_cells"))
        cells = F.concat(F.array(_value(F.col("level"), False), _value(F.col("line"), True)), F.transform("_order", lambda o: _value(F.try_element_at("_cells", o["position"]), False)))
        parts.append(_rows(lines.join(order, F.col(name) == F.col("_name")), F.col(name), i, sheet, [1, F.col("order_index"), F.xxhash64("line")], cells))
    told = issues.select(F.col(name).alias("_name"), *[F.col(c).alias(t) for c, t in zip(["statement", "line", "issue", "period", "detail"], ISSUES, strict=True)])
    return reduce(DataFrame.unionAll, parts).unionAll(table_sheet(told, F.col("_name"), len(SERIES_SHEETS), ISSUE_SHEET, ISSUES, [F.xxhash64(*ISSUES)]))


def write_workbooks(rows: DataFrame, path: str, mode: str = "append") -> None:
    """One workbook at ``path`` for each name in ``rows`` (as ``document_sheets`` makes them)."""
    rows.sparkSession.dataSource.register(WorkbookSink)
    rows.repartition("name").sortWithinPartitions("name", "sheet_no", "at").write.format("tallyframe_workbooks").mode(mode).save(path)


def write_files(files: DataFrame, path: str, suffix: str = "", mode: str = "append") -> None:
    """One file at ``path`` for each row of ``files`` (name, content)."""
    files.sparkSession.dataSource.register(FileSink)
    files.select("name", "content").write.format("tallyframe_files").option("suffix", suffix).mode(mode).save(path)


def text_subset(raw: bytes, pages: list[int]) -> bytes:
    """Pages of a text whose pages end with form feeds."""
    every = raw.split(b"\f")
    return b"\f".join(every[i] for i in pages if i < len(every))


def pypdf_subset(raw: bytes, pages: list[int]) -> bytes:
    """Pages of a PDF file by pypdf, where that is installed."""
    import io

    try:
        from pypdf import PdfReader, PdfWriter
    except ImportError as e:
        raise RuntimeError("writing PDF files needs pypdf; pass another backend") from e
    source, out, held = PdfReader(io.BytesIO(raw)), PdfWriter(), io.BytesIO()
    for i in pages:
        if i < len(source.pages):
            out.add_page(source.pages[i])
    out.write(held)
    return held.getvalue()


def subsets(files: DataFrame, selected: DataFrame, subset: Callable[[bytes, list[int]], bytes] = pypdf_subset) -> DataFrame:
    """name, content: each document with its selected pages only, every page once and in order; numbers out of range are ignored.

    files: path, content. selected: doc_id (the path), page_idx. Documents without a selected page give no file; the name is the path's last part without its ending.
    """
    wanted = selected.filter("page_idx >= 0").groupBy("doc_id").agg(F.array_sort(F.collect_set("page_idx")).alias("pages"))
    met = files.select("path", "content").join(wanted, F.col("path") == F.col("doc_id"))
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, raw, pages in zip(b.column(0), b.column(1), b.column(2)):
                yield pa.RecordBatch.from_arrays([pa.array([n.as_py()]), pa.array([subset(raw.as_py() or b"", pages.as_py())], pa.binary())], names=["name", "content"])

    return met.select(name.alias("name"), "content", "pages").mapInArrow(run, "name string, content binary")
