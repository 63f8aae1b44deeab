"""Selecting statement pages from (document, page, text) relations. Key and order columns are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import text as T


def statement_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row per page and statement that the page starts: all columns and ``statement``."""
    found = F.array_compact(F.array(*[F.when(T.statement_page(F.col(text), T.any_case(T.HEADINGS[s]), T.ANCHORS[s], T.ANCHOR_MIN[s]), F.lit(s)) for s in ("balance", "income", "cash")]))
    return pages.withColumn("statement", F.explode(found))


def low_text(pages: DataFrame, doc: str, page: str, text: str, sample: int = 8, least: int = 2000) -> DataFrame:
    """Documents whose first ``sample`` pages hold fewer than ``least`` characters, with that number."""
    return pages.filter(F.col(page) < sample).groupBy(doc).agg(F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("chars")).filter(F.col("chars") < least)


def nearest_page(hints: DataFrame, valid: DataFrame, hint: str, page: str, window: int = 20, by: list[str] = ()) -> DataFrame:
    """Each hint's closest valid page within ``window``, ties to the lower page.

    A range join by cells of ``window`` pages: a hint meets its own cell and the two beside it.
    """
    cell = lambda c: F.floor(c / window)
    near = hints.withColumn("_cell", F.explode(F.array(*[cell(F.col(hint)) + d for d in (-1, 0, 1)])))
    far = F.abs(F.col(page) - F.col(hint))
    met = near.join(valid.withColumn("_cell", cell(F.col(page))), ["_cell", *by]).filter(far <= window)
    return met.groupBy(*by, hint).agg(F.min(F.struct(far.alias("distance"), F.col(page).alias(page))).alias("_m")).select(*by, hint, f"_m.{page}", "_m.distance")


def first_match(lines: DataFrame, doc: str, order: list[str], value: str) -> DataFrame:
    """The first line of each document, in order, where ``value`` is not null."""
    return lines.filter(F.col(value).isNotNull()).groupBy(doc).agg(F.min_by(F.struct(*order, value), F.struct(*order)).alias("_m")).select(doc, "_m.*")


def continuations(pages: DataFrame, doc: str, page: str, start: Column, goes_on: Column, most: int = 2) -> DataFrame:
    """Pages that a start page takes along: the following ones while ``goes_on``, at most ``most``."""
    w = Window.partitionBy(doc).orderBy(page)
    marked = pages.withColumn("_start", start).withColumn("_on", goes_on)
    reach, upto = F.lit(0), F.lit(True)
    for i in range(1, most + 1):
        upto = upto & F.coalesce(F.lead("_on", i).over(w), F.lit(False))
        reach = F.when(upto, i).otherwise(reach)
    return marked.withColumn("extra", reach).filter("_start").select(doc, page, "extra")


def fill_statement(pages: DataFrame, doc: str, page: str, title: Column, name: str = "statement") -> DataFrame:
    """Each page belongs to the last title at or before it; pages before the first title to none."""
    w = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn(name, F.last(title, ignorenulls=True).over(w))


def first_occurrence(rows: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """The first row of each value, in order: deduplication that keeps the order."""
    return rows.groupBy(*by, value).agg(F.min(F.struct(*order)).alias("_m")).select(*by, value, "_m.*")


def least_span(pages: DataFrame, doc: str, page: str, kind: Column, kinds: list[str]) -> DataFrame:
    """The tightest set of pages with one of each kind, by document; ties to the earliest end.

    The best set that ends at a page takes the latest page of every kind up to it, so one pass
    in page order does; triples are never formed.
    """
    w = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    held = pages.withColumn("_kind", kind)
    for i, k in enumerate(kinds):
        held = held.withColumn(f"_k{i}", F.max(F.when(F.col("_kind") == k, F.col(page))).over(w))
    lasts = [f"_k{i}" for i in range(len(kinds))]
    whole = held.filter(" and ".join(f"{c} is not null" for c in lasts)).withColumn("span", F.greatest(*lasts) - F.least(*lasts))
    best = whole.groupBy(doc).agg(F.min(F.struct("span", F.greatest(*lasts).alias("last_page"), F.least(*lasts).alias("first_page"))).alias("_m"))
    return best.select(doc, "_m.*")
