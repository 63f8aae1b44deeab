"""Page selection end to end: from page texts to the pages of each statement.

Pages: doc, page (0-based), text. Everything a page says by itself is computed once as flags; what
remains are small tables by document: hints, printed pages, mapped pages, continuations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import text as T
from tallyframe.operators import pages as P
from tallyframe.tables import written

STATEMENTS = ("balance", "income", "cash")
#: Pages scanned for a table of contents; printed pages around the hint; pages from a printed page to its heading; continuation pages; least density.
SCAN, DELTA, NEAR, MORE, DENSITY = 12, 6, 20, 2, 4
# Index lines by statement.
INDEX_LINES = {"balance": r"balance sheet", "income": r"statements?\s+of\s+(operations|income|earnings)", "cash": r"statements of cash flows"}


def flagged(pages: DataFrame, doc: str = "doc_id", page: str = "page_idx", text: str = "text", headings: dict[str, str] | None = None) -> DataFrame:
    """Pages that have a flag, computed once and written: contents, index (an index page), stop, and by statement hit_ (heading anywhere), valid_ (a statement page), on_ (goes on).

    The text stays for contents and index pages only.
    """
    heads = headings or {s: T.any_case(T.HEADINGS[s]) for s in STATEMENTS}
    t = F.col("text")
    dense = T.numeric_density(t)
    flags = [t.rlike(T.any_case(T.CONTENTS)).alias("contents"), t.rlike(T.any_case(T.INDEX_PAGE)).alias("index"), (t.rlike(T.any_case(T.INDEX_PAGE)) | reduce(lambda a, b: a | b, [t.rlike(T.any_case(p)) for p in T.OTHER_STATEMENTS])).alias("stop")]
    for s in STATEMENTS:
        flags.append(t.rlike(heads[s]).alias(f"hit_{s}"))
        flags.append(F.coalesce(T.statement_page(t, heads[s], T.ANCHORS[s], T.ANCHOR_MIN[s]), F.lit(False)).alias(f"valid_{s}"))
        goes = (t.rlike(T.any_case(T.CONTINUED)) | T.heading_line(t, heads[s])) & (dense >= DENSITY) & (T.anchor_hits(t, T.ANCHORS[s]) >= max(2, T.ANCHOR_MIN[s] - 1))
        flags.append((goes & (t != "") & ~F.col("stop")).alias(f"on_{s}"))
    base = pages.select(F.col(doc).alias("doc_id"), F.col(page).alias("page_idx"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = base.select("*", *flags[:3]).select("*", *flags[3:])
    names = [c for c in found.columns if c not in ("doc_id", "page_idx", "text")]
    return written(found.filter(" or ".join(names)).withColumn("text", F.when(F.col("contents") | F.col("index"), F.col("text"))), "flags")


def contents_hint(pages: DataFrame) -> DataFrame:
    """doc_id, hint: the printed page at the end of the first line on financial statements in a table of contents among the first pages."""
    lines = pages.filter((F.col("page_idx") < SCAN) & F.col("contents")).select("doc_id", "page_idx", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    number = F.regexp_extract("line", r"(\d{1,3})\s*$", 1)
    found = lines.filter(F.contains(F.lower("line"), F.lit("financial statements")) & (number != ""))
    return found.groupBy("doc_id").agg(F.min_by(number.cast("int"), F.struct("page_idx", "n")).alias("hint"))


def inner_index(flags: DataFrame, hints: DataFrame) -> DataFrame:
    """doc_id, index_page: the index page closest to the hint (ties, and without a hint, the first)."""
    met = flags.filter("index").join(hints, "doc_id", "left")
    far = F.coalesce(F.abs(F.col("page_idx") - (F.col("hint") - 1)), F.lit(0))
    return met.groupBy("doc_id").agg(F.min_by("page_idx", F.struct(far, "page_idx")).alias("index_page"))


def printed_map(flags: DataFrame, hints: DataFrame, index: DataFrame, delta: int = DELTA) -> DataFrame:
    """doc_id, statement, printed, nth: page numbers in the lines of the index page; without one, statement pages around the hint."""
    lines = flags.join(index, "doc_id").filter("page_idx = index_page").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    number = F.regexp_extract("line", r"(\d{1,3})\s*$", 1)
    kinds = F.array_compact(F.array(*[F.when(F.lower("line").rlike(p), F.lit(s)) for s, p in INDEX_LINES.items()]))
    listed = lines.filter(number != "").select("doc_id", F.explode(kinds).alias("statement"), number.cast("int").alias("printed"), F.col("n").cast("int").alias("nth"))
    valid = F.array_compact(F.array(*[F.when(F.col(f"valid_{s}"), F.lit(s)) for s in STATEMENTS]))
    around = flags.join(hints, "doc_id").join(index, "doc_id", "left_anti").filter(F.abs(F.col("page_idx") - (F.col("hint") - 1)) <= delta)
    return listed.union(around.select("doc_id", F.explode(valid).alias("statement"), F.col("page_idx") + 1, "page_idx"))


def mapped_pages(flags: DataFrame, printed: DataFrame, near: int = NEAR) -> DataFrame:
    """doc_id, statement, page_idx, nth: each printed page's closest statement page; else the first statement page, else the first heading."""
    kinds = F.array_compact(F.array(*[F.when(F.col(f"hit_{s}"), F.struct(F.lit(s).alias("statement"), F.col(f"valid_{s}").alias("valid"))) for s in STATEMENTS]))
    hits = flags.select("doc_id", "page_idx", F.explode(kinds).alias("_h")).select("doc_id", "page_idx", "_h.*")
    valid = hits.filter("valid").select("doc_id", "statement", "page_idx")
    far = F.abs(F.col("page_idx") + 1 - F.col("printed"))
    met = printed.join(valid, ["doc_id", "statement"]).filter(far <= near)
    best = met.groupBy("doc_id", "statement", "printed", "nth").agg(F.min_by("page_idx", F.struct(far, "page_idx")).alias("page_idx")).groupBy("doc_id", "statement", "page_idx").agg(F.min("nth").alias("nth"))
    first = hits.groupBy("doc_id", "statement").agg(F.min_by("page_idx", F.struct(~F.col("valid"), "page_idx")).alias("page_idx"))
    rest = first.join(best, ["doc_id", "statement"], "left_anti").select("doc_id", "statement", "page_idx", F.lit(0).alias("nth"))
    return best.select("doc_id", "statement", "page_idx", "nth").union(rest)


def with_continuations(flags: DataFrame, starts: DataFrame) -> DataFrame:
    """doc_id, statement, page_idx, position: start pages with those that continue them, each page once, in order."""
    w = Window.partitionBy("doc_id").orderBy("page_idx")
    ahead, reach = flags, []
    for i in range(1, MORE + 1):
        ahead = ahead.withColumn(f"next_{i}", F.when(F.lead("page_idx", i).over(w) == F.col("page_idx") + i, F.lead(F.struct(*[f"on_{s}" for s in STATEMENTS]), i).over(w)))
    for s in STATEMENTS:
        upto, n = F.lit(True), F.lit(0)
        for i in range(1, MORE + 1):
            upto = upto & F.coalesce(F.col(f"next_{i}.on_{s}"), F.lit(False))
            n = F.when(upto, i).otherwise(n)
        reach.append(F.struct(F.lit(s).alias("statement"), n.alias("more")))
    far = ahead.select("doc_id", "page_idx", F.explode(F.array(*reach)).alias("_r")).select("doc_id", "page_idx", "_r.*")
    taken = starts.join(far, ["doc_id", "statement", "page_idx"])
    each = taken.select("doc_id", "statement", "nth", F.col("page_idx").alias("start"), F.explode(F.sequence("page_idx", F.col("page_idx") + F.col("more"))).alias("page_idx"))
    return each.groupBy("doc_id", "statement", "page_idx").agg(F.min(F.struct("nth", "start")).alias("position"))


def select_pages(pages: DataFrame, near: int = NEAR, delta: int = DELTA, **columns: str) -> DataFrame:
    """doc_id, statement, page_idx, position: the pages of each document's statements.

    ``near``: pages between a printed number and its statement at most; ``delta``: pages around the hint of the contents where there is no index.
    """
    flags = flagged(pages, **columns)
    hints = contents_hint(flags)
    return with_continuations(flags, mapped_pages(flags, printed_map(flags, hints, inner_index(flags, hints), delta), near))


def grouped(selected: DataFrame) -> DataFrame:
    """doc_id, statement, pages (array in order)."""
    put = F.transform(F.array_sort(F.collect_list(F.struct("position", "page_idx"))), lambda x: x["page_idx"])
    return selected.groupBy("doc_id", "statement").agg(put.alias("pages"))


def first_hits(flags: DataFrame, selected: DataFrame) -> DataFrame:
    """For statements that have no page: their first statement page with its continuations."""
    valid = F.array_compact(F.array(*[F.when(F.col(f"valid_{s}"), F.lit(s)) for s in STATEMENTS]))
    first = flags.select("doc_id", "page_idx", F.explode(valid).alias("statement")).groupBy("doc_id", "statement").agg(F.min("page_idx").alias("page_idx"))
    lacks = first.join(selected.select("doc_id", "statement").distinct(), ["doc_id", "statement"], "left_anti")
    return with_continuations(flags, lacks.withColumn("nth", F.lit(0)))


def median_window(flags: DataFrame, pages: DataFrame, reach: int = 4) -> DataFrame:
    """doc_id, page_idx: pages around the median statement page of documents that lack statement pages of some kind."""
    each = [F.collect_list(F.when(F.col(f"valid_{s}"), F.col("page_idx"))).alias(s) for s in STATEMENTS]
    held = flags.groupBy("doc_id").agg(*each)
    lacks = reduce(lambda a, b: a | b, [F.size(s) == 0 for s in STATEMENTS])
    pool = F.array_sort(F.concat(*STATEMENTS))
    middle = F.get(pool, F.floor(F.size(pool) / 2).cast("int"))
    return held.filter(lacks & (F.size(pool) > 0)).select("doc_id", F.explode(F.sequence(F.greatest(middle - reach, F.lit(0)), middle + reach)).alias("page_idx")).join(pages.select("doc_id", "page_idx"), ["doc_id", "page_idx"], "left_semi")


def least_triples(flags: DataFrame) -> DataFrame:
    """doc_id, first_page, last_page: the tightest balance, income and cash pages of documents that have all three; ties to the earliest balance, then income, then cash page.

    The least span comes from one walk over the pages (``pages.least_span``); the pages that reach it are then looked up in
    the document's own arrays of pages, so triples are never formed.
    """
    kinds = F.array_compact(F.array(*[F.when(F.col(f"valid_{s}"), F.lit(s)) for s in STATEMENTS]))
    each = flags.select("doc_id", "page_idx", F.explode(kinds).alias("kind"))
    spans = P.least_span(each, "doc_id", "page_idx", F.col("kind"), list(STATEMENTS)).select(F.col("doc_id").alias("_d"), "span")
    held = each.groupBy("doc_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == s, F.col("page_idx")))).alias(s) for s in STATEMENTS])
    met = held.join(spans, F.col("doc_id") == F.col("_d"))

    def with_income(b: Column) -> Column:
        def with_cash(i: Column) -> Column:
            low, high = F.least(b, i), F.greatest(b, i)
            cash = F.array_min(F.filter("cash", lambda c: (c >= high - F.col("span")) & (c <= low + F.col("span"))))
            return F.when(cash.isNotNull(), F.struct(b.alias("b"), i.alias("i"), cash.alias("c")))

        return F.array_compact(F.transform(F.filter("income", lambda i: F.abs(i - b) <= F.col("span")), with_cash))

    best = F.array_min(F.flatten(F.transform("balance", with_income)))
    return met.withColumn("_m", best).select("doc_id", F.least("_m.b", "_m.i", "_m.c").alias("first_page"), F.greatest("_m.b", "_m.i", "_m.c").alias("last_page"))


def cluster_pages(flags: DataFrame, pages: DataFrame, before: int = 4, after: int = 5) -> DataFrame:
    """doc_id, page_idx: a document's statement pages by where they cluster, for documents that nothing else could place.

    With statement pages of all three kinds: those from ``before`` pages ahead of the tightest three to ``after``
    behind them, each tested again and with its continuations. Else the pages around the median
    statement page; without any, none.
    """
    window = least_triples(flags)
    valid = F.array_compact(F.array(*[F.when(F.col(f"valid_{s}"), F.lit(s)) for s in STATEMENTS]))
    near = flags.join(window, "doc_id").filter((F.col("page_idx") >= F.col("first_page") - before) & (F.col("page_idx") <= F.col("last_page") + after))
    starts = near.select("doc_id", "page_idx", F.explode(valid).alias("statement"), F.lit(0).alias("nth"))
    return with_continuations(flags, starts).select("doc_id", "page_idx").distinct().unionByName(median_window(flags, pages, before))


def page_subset(pages: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected pages' rows, each once in page order; page numbers out of range are ignored."""
    wanted = selected.select("doc_id", "page_idx").distinct()
    return pages.join(wanted, ["doc_id", "page_idx"], "left_semi")


def coverage_score(filings: DataFrame, quarters: Column, years: Column, want_quarters: Column, want_years: Column) -> DataFrame:
    """``score``: how many of the wanted quarters and years each filing covers."""
    return filings.withColumn("score", F.size(F.array_intersect(quarters, want_quarters)) + F.size(F.array_intersect(years, want_years)))
