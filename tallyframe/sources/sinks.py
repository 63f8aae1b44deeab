"""Sinks: one folder per sheet, logs as JSON, page subsets, and where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = [
    "Source PDF", "Statement", "Order Index", "Level", "Line Item (as printed)", "Column Header (as printed)", "Value (in millions)",
    "Original Units", "Saved Units", "Units Assumption", "Audited/Unaudited", "Page",
]
ISSUES = ["Statement", "Line Item", "Issue", "Period", "Detail"]


def write_sheets(sheets: dict[str, DataFrame], path: str, format: str = "parquet") -> None:
    """Each frame to its own folder; frames without columns are skipped."""
    for name, df in sheets.items():
        if df.columns:
            df.write.mode("overwrite").format(format).option("header", "true").save(f"{path}/{name}")


def write_long(facts: DataFrame, certification: DataFrame, path: str) -> None:
    write_sheets({"long_all": facts, "certification": certification}, path)


def pivoted(facts: DataFrame, by: list[str], column: str, value: str, order: list[str]) -> DataFrame:
    """The wide table of a sheet: a column for each of its columns' names, in the order of their first place."""
    names = [r[0] for r in facts.groupBy(column).agg(F.min(F.struct(*order)).alias("o")).orderBy("o").select(column).collect()]
    return facts.groupBy(*by).pivot(column, names).agg(F.first(value)).orderBy(*by)


def write_workbook(facts: DataFrame, headers: DataFrame, certification: DataFrame, path: str) -> None:
    """A folder per document's sheet: three wide statements, their header blocks, the long table and the checks.

    Columns' names differ by document, so a statement is written long and partitioned by document; ``pivoted`` makes one wide.
    """
    for name in ("income", "balance", "cash"):
        facts.filter(F.col("statement") == name).write.mode("overwrite").partitionBy("doc_id").parquet(f"{path}/{name}")
    write_sheets({"headers": headers, "long_all": facts, "certification": certification}, path)


def write_series(frames: DataFrame, issues: DataFrame, path: str) -> None:
    """Time series by statement, only of statements that have any, and diagnostics if there are any."""
    for r in frames.select("statement").distinct().collect():
        frames.filter(F.col("statement") == r["statement"]).write.mode("overwrite").parquet(f"{path}/{r['statement']}")
    if issues.head(1):
        issues.write.mode("overwrite").parquet(f"{path}/diagnostics")


def prepared_long(facts: DataFrame) -> DataFrame:
    """The long table's twelve columns in order; missing ones are empty text."""
    return facts.select(*[F.col(f"`{c}`") if c in facts.columns else F.lit("").alias(c) for c in LONG])


def with_certification(parts: list[DataFrame]) -> DataFrame:
    """Checks of documents and of the batch together; columns that a part lacks are empty."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.na.fill("")


def write_subset(pages: DataFrame, path: str) -> None:
    """Selected pages' texts by document, in page order within a file."""
    pages.repartition("doc_id").sortWithinPartitions("doc_id", "page_idx").write.mode("overwrite").partitionBy("doc_id").parquet(path)


def write_log(events: DataFrame, path: str, totals: DataFrame | None = None) -> None:
    """One JSON object per event, and totals beside them; nothing is written without events."""
    if events.head(1):
        events.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
        if totals is not None:
            totals.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path.rstrip('/')}-totals")


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", "true").csv(path)


def results_json(results: DataFrame, errors: DataFrame) -> tuple[list[str], int]:
    """JSON lines of results and errors for a terminal, and the exit code: 1 if there is an error."""
    lines = [f'{{"result": {x}}}' for x in results.toJSON().toLocalIterator()]
    bad = [f'{{"error": {x}}}' for x in errors.toJSON().toLocalIterator()]
    return [*lines, *bad], int(bool(bad))


def output_path(source: str, given: str | None = None, suffix: str = " - FS only (robust)") -> str:
    """Where the selected pages of a document go: the given path, else beside it."""
    if given:
        return given
    folder, _, name = source.rpartition("/")
    return f"{folder}/{name.rsplit('.', 1)[0]}{suffix}.pdf" if folder else f"{name.rsplit('.', 1)[0]}{suffix}.pdf"
