"""From positioned words to certified tables: all steps over all documents, with an errors frame beside them.

words -> statement of each page -> tables -> settled labels -> facts -> checks of documents -> fiscal values -> checks
of the batch. A document that lacks a statement, or whose statement gives no table, is told in the errors
frame and is in none of the results; the others do not notice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import labels as L
from tallyframe.functions import lines as N
from tallyframe.operators import batch, documents, extract, fiscal, pages
from tallyframe.operators.facts import without_existing
from tallyframe.sources import sinks, workbooks
from tallyframe.tables import numbered, written

STATEMENTS = ["income", "balance", "cash"]
ERRORS = "doc_id string, step string, error string"
#: Rows of one document that fit between two documents in the order of ingestion.
ROWS = 1 << 24


@dataclass
class Reports:
    """facts: doc_id, statement, order_index, level, label, raw, reasons, col_ord, column, raw_column, duration, period_end, value. blocks: what
    a statement's first page says. checks, batch_checks: check, result, details. errors: doc_id, step, error."""

    facts: DataFrame
    blocks: DataFrame
    checks: DataFrame
    batch_checks: DataFrame
    errors: DataFrame


def statement_words(words: DataFrame, statements: list[str] = STATEMENTS) -> DataFrame:
    """Words of the pages from the first title of a statement on, with the statement: that of the last title at or before the page.

    Of several titles on a page the first in the order of ``statements`` counts.
    """
    w = F.struct(F.bround("top", 1).alias("top"), F.col("x0").alias("x"), F.btrim("text").alias("t"))
    texts = words.groupBy("doc_id", "page_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(w)), lambda x: x["t"]), " ").alias("_text"))
    title = F.coalesce(*[F.when(F.col("_text").rlike(N.TITLE_LINES[s]), F.lit(s)) for s in statements])
    filled = pages.fill_statement(texts, "doc_id", "page_idx", title).filter("statement is not null").select("doc_id", "page_idx", "statement")
    return words.join(filled, ["doc_id", "page_idx"])


def _failed(lacks: DataFrame, step: str, text: str) -> DataFrame:
    return lacks.select("doc_id", F.lit(step).alias("step"), F.concat(F.lit(text), F.array_join(F.array_sort("missing"), ", ")).alias("error"))


def facts_of_batch(facts: DataFrame) -> DataFrame:
    """Facts as ``fiscal.ingested`` takes them, all documents one batch; documents come in the order of their names, later ones restate earlier ones."""
    names = numbered(facts.select("doc_id").distinct(), ["doc_id"]).select(F.col("doc_id").alias("_d"), "nth")
    return facts.join(names, F.col("doc_id") == F.col("_d")).select(
        F.lit("Batch").alias("batch"), "statement", F.col("label").alias("canonical"), L.canonical(F.col("label")).alias("label"), "level", "order_index", "column",
        F.col("raw_column").alias("raw_label"), "duration", "period_end", "value", F.col("doc_id").alias("source"), (F.col("nth") * ROWS + F.col("order_index")).alias("seq"),
    )


def measurement_store(facts: DataFrame) -> DataFrame:
    """The measurements of all documents together."""
    values, _ = fiscal.ingested(facts_of_batch(facts), ["batch"])
    slots, _ = fiscal.slot_keys(fiscal.period_keys(values, ["batch"]), ["batch"])
    return fiscal.measurements(values, slots, ["batch"])


def series_tables(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fiscal tables of all documents together (batch, statement, order_index, level, line, position, column, value), and their issues."""
    values, lost = fiscal.ingested(facts_of_batch(facts), ["batch"])
    slots, more = fiscal.slot_keys(fiscal.period_keys(values, ["batch"]), ["batch"])
    series, last = fiscal.fiscal_series(fiscal.slotted(values, slots, ["batch"]), ["batch"])
    return fiscal.frames(series, ["batch"]), fiscal.diagnostics(lost, more, last)


def extract_reports(words: DataFrame, aliases: DataFrame | None = None, unread: DataFrame | None = None) -> Reports:
    """All results of the documents in ``words`` (doc_id, page_idx, text, x0, x1, top). ``unread``: doc_id, page_idx, error of what could not be read."""
    spark = words.sparkSession
    placed = written(statement_words(words), "statement-words")
    lacks = placed.groupBy("doc_id").agg(F.array_except(F.array(*map(F.lit, STATEMENTS)), F.collect_set("statement")).alias("missing"))
    lacks = words.select("doc_id").distinct().join(lacks.withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d"), "left")
    lacks = written(lacks.select("doc_id", F.coalesce("missing", F.array(*map(F.lit, STATEMENTS))).alias("missing")).filter(F.size("missing") > 0), "lacking")
    whole = placed.join(lacks, "doc_id", "left_anti")
    table = written(extract.table_rows(whole, ["doc_id", "statement"], aliases=aliases), "facts")
    facts, empty = extract.complete_documents(table, "doc_id")
    none = whole.select("doc_id").distinct().join(table.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("missing", F.array(*map(F.lit, STATEMENTS)))
    errors = _failed(lacks, "pages", "no page of: ").unionByName(_failed(empty.unionByName(none), "tables", "no table of: "))
    if unread is not None:
        errors = errors.unionByName(unread.select("doc_id", F.lit("words").alias("step"), F.concat_ws(": ", F.concat(F.lit("page "), F.col("page_idx") + 1), "error").alias("error")))
    facts = written(facts, "facts")
    blocks = written(extract.statement_blocks(whole, ["doc_id", "statement"]).join(facts.select("doc_id").distinct(), "doc_id", "left_semi"), "blocks")
    checks = documents.certify_documents(facts, blocks.withColumn("statement_name", F.col("title")))
    everything = batch.certify_all(measurement_store(facts)) if not facts.isEmpty() else spark.createDataFrame([], "`Source PDF` string, `Check` string, `Result` string, `Details` string")
    return Reports(facts, blocks, written(checks, "checks"), everything, written(errors, "errors"))


def pending(words: DataFrame, done: DataFrame, name: str = "name") -> DataFrame:
    """Words of documents that ``done`` (``name``: the document's name) does not hold: a run goes on where it stopped."""
    return without_existing(words.withColumn("_n", document_name("doc_id")), done, "_n", name).drop("_n")


def document_name(path: str) -> Column:
    """A path's last part without its ending."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def long_table(reports: Reports) -> DataFrame:
    """The stacked table of all documents, twelve columns."""
    b = reports.blocks.select(*[F.col(c).alias(f"b_{c}") for c in reports.blocks.columns])
    met = reports.facts.join(b, (F.col("doc_id") == F.col("b_doc_id")) & (F.col("statement") == F.col("b_statement")))
    values = [
        F.substring_index("doc_id", "/", -1), F.col("b_title"), F.col("order_index"), F.col("level"), F.col("label"), F.col("column"), F.col("value"), F.col("b_original_units"),
        F.lit(workbooks.SAVED_UNITS), F.coalesce("b_units_assumption", F.lit("")), F.col("b_audited"), F.col("b_source"),
    ]
    return met.select(*[v.alias(n) for v, n in zip(values, sinks.LONG, strict=True)])


def certification(reports: Reports) -> DataFrame:
    """Checks of documents, then those of the batch, as one table."""
    own = reports.checks.select(F.substring_index("doc_id", "/", -1).alias("Source PDF"), F.col("check").alias("Check"), F.col("result").alias("Result"), F.col("details").alias("Details"))
    return sinks.with_certification([own, reports.batch_checks])


def write_reports(reports: Reports, path: str, per_file: str | None = None) -> None:
    """The stacked table and its certification at ``path``, errors and issues beside them; with ``per_file`` a workbook a document there."""
    sinks.write_long(long_table(reports), certification(reports), path)
    reports.errors.write.mode("overwrite").parquet(f"{path}/errors")
    if per_file:
        named = lambda df: df.withColumn("doc_id", F.concat(document_name("doc_id"), F.lit("_tables")))
        workbooks.write_workbooks(workbooks.document_sheets(named(reports.facts), named(reports.blocks), named(reports.checks)), per_file)
