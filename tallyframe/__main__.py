"""Command line: select statement pages, extract and certify tables, plan reports.

python -m tallyframe select [INPUT] [--output-dir DIR] | extract [FILE] [--batch DIR] | certify FACTS OUT | demo OUT | plan --latest PERIOD
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tallyframe as tf
from tallyframe.operators import facts as facts_
from tallyframe.operators import planner, run, select
from tallyframe.sources import readers, sinks, words, workbooks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tallyframe")
    kinds = out.add_subparsers(dest="command", required=True)
    sub = kinds.add_parser("select", help="pages of statements, from files or from a Parquet table of doc_id, page_idx, text")
    sub.add_argument("input", help="a file, a folder of files, or with --pages a table of page texts")
    sub.add_argument("out", nargs="?", help="folder of the result")
    sub.add_argument("--pages", action="store_true", help="the input is a table of page texts")
    sub.add_argument("--output-dir", help="folder of the selected pages, a file a document")
    sub.add_argument("--backend", help="module:function that gives a file's page texts")
    sub.add_argument("--subset", help="module:function that makes a file of some pages of another")
    sub.add_argument("--auto-ocr", action="store_true", help="recognise text of documents that have little")
    sub.add_argument("--search-window", type=int, default=select.NEAR, help="pages between a printed number and its statement at most")
    sub.add_argument("--toc-delta", type=int, default=select.DELTA, help="pages around the hint of the contents where there is no index")
    sub.add_argument("--overwrite", action="store_true", help="documents that have a result are selected again")
    sub = kinds.add_parser("extract", help="tables, checks and workbooks, from files")
    sub.add_argument("file", nargs="?")
    sub.add_argument("--batch", help="a folder of files")
    sub.add_argument("--output", default="tables", help="folder of the stacked table")
    sub.add_argument("--per-file", action="store_true", help="a workbook for each document too")
    sub.add_argument("--per-file-dir", default="workbooks")
    sub.add_argument("--aliases", help="file of aliases")
    sub.add_argument("--backend", help="module:function that gives a file's positioned words")
    sub = kinds.add_parser("certify", help="checks of documents, from a Parquet table of facts")
    sub.add_argument("facts")
    sub.add_argument("out")
    sub = kinds.add_parser("demo", help="the demo filing and its checks")
    sub.add_argument("out")
    sub = kinds.add_parser("plan", help="the reports that cover a history")
    sub.add_argument("--latest", required=True, help="FY2024 or Q1 2026")
    sub.add_argument("--years", type=int, default=10)
    sub.add_argument("--json", action="store_true")
    return out


def _named(spec: str | None, default):
    if not spec:
        return default
    module, _, function = spec.partition(":")
    return getattr(importlib.import_module(module), function)


def _print_rows(rows: DataFrame, most: int = 1000) -> int:
    """Prints JSON lines, the first ``most`` of them; how many there are."""
    n = rows.count()
    print("\n".join(r[0] for r in rows.select(F.to_json(F.struct("*"))).limit(most).collect()))
    if n > most:
        print(f"... and {n - most} more")
    return n


def _select(spark: SparkSession, given: argparse.Namespace) -> int:
    if given.pages:
        pages = spark.read.parquet(given.input)
    else:
        files = readers.document_files(spark, given.input)
        if given.output_dir and not given.overwrite:
            done = readers.existing_files(spark, given.output_dir)
            names = done.select(F.regexp_replace(run.document_name("path"), r" - FS only \(robust\)$", "").alias("name"))
            files = facts_.without_existing(files.withColumn("_n", run.document_name("path")), names, "_n", "name").drop("_n")
        read = _named(given.backend, None) or readers.available_backend()
        pages = readers.page_texts(files, read)
        if given.auto_ocr:
            pages = readers.with_ocr(files, pages, tf.low_text(pages, "doc_id", "page_idx", "text"), read)
    chosen = select.select_pages(pages, near=given.search_window, delta=given.toc_delta)
    if given.out:
        chosen.write.mode("overwrite").parquet(given.out)
        chosen = spark.read.parquet(given.out)
    if given.output_dir and not given.pages:
        workbooks.write_files(workbooks.subsets(files, chosen, _named(given.subset, workbooks.pypdf_subset)), given.output_dir, " - FS only (robust).pdf")
    _print_rows(select.grouped(chosen))
    return int(_print_rows(pages.select("doc_id").distinct().join(chosen.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("error", F.lit("no statement pages"))) > 0)


def _extract(spark: SparkSession, given: argparse.Namespace) -> int:
    source = words.word_source(_named(given.backend, words.pdfplumber_words), "tallyframe_given_words")
    spark.dataSource.register(source)
    read = lambda path, rows: spark.read.format("tallyframe_given_words").option("rows", rows).option("recursive", "false").load(path)
    paths = [p for p in (given.file, given.batch) if p]
    found, unread = read(paths[0], "words"), read(paths[0], "errors")
    for p in paths[1:]:
        found, unread = found.union(read(p, "words")), unread.union(read(p, "errors"))
    aliases = readers.aliases(spark, given.aliases) if given.aliases else None
    reports = run.extract_reports(found, aliases, unread)
    run.write_reports(reports, given.output, given.per_file_dir if given.per_file else None)
    failed = _print_rows(reports.errors)
    _print_rows(run.certification(reports).filter("Result not in ('PASS', 'INFO')"))
    return int(bool(failed) and reports.facts.isEmpty())


def _plan(spark: SparkSession, given: argparse.Namespace) -> int:
    try:
        if given.json:
            year, quarter = planner.parse_period(given.latest)
            asked = spark.createDataFrame([(given.latest, year, quarter, given.years)], "request string, year int, quarter int, years int")
            print(planner.plan_json(asked).first()["plan"])
        else:
            for r in planner.plan(spark, given.latest, given.years).orderBy("form", F.desc("year"), "quarter").collect():
                print(f"{r['form']} {r['year']}" + (f" Q{r['quarter']}" if r["form"] != "10-K" else ""))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def main(argv: list[str] | None = None) -> int:
    given = parser().parse_args(argv)
    if given.command == "extract" and not (given.file or given.batch):
        parser().error("give a file or --batch")
    spark = SparkSession.builder.appName("tallyframe").getOrCreate()
    if given.command in ("select", "extract", "plan"):
        return {"select": _select, "extract": _extract, "plan": _plan}[given.command](spark, given)
    facts = spark.read.parquet(given.facts) if given.command == "certify" else tf.demo_facts(spark).withColumnRenamed("period", "column").selectExpr("*", "'' AS duration", "'' AS period_end")
    checks = tf.certify_documents(facts)
    sinks.write_long(facts, checks, given.out)
    _print_rows(spark.read.parquet(f"{given.out}/certification").filter("result = 'CHECK'").orderBy("doc_id", "check"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
