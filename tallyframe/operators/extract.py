"""From positioned words to facts: column headers, rows and labels of statement tables.

Words are dealt by statement once. Two passes stream a statement's lines in order: the first finds
the columns (names and centres), the second puts rows together; all that a line says by itself
(which lines to skip, which tokens are numbers, labels, names of periods) is column expressions.
A statement may have any number of lines; a task holds its open row and its header lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import describe as D
from tallyframe.functions import lines as N
from tallyframe.functions import numbers as A
from tallyframe.functions import periods as R
from tallyframe.functions import rewrites as W
from tallyframe.operators import statements as S
from tallyframe.operators.relabel import settled
from tallyframe.tables import written

#: Points between tokens that part header groups; points around a column that hold its numbers.
GROUP_GAP, REACH = 40.0, 45.0
SHARE = re.compile(r"(share|shares|issued|outstanding|respectively)", re.I)
SHARE_END = re.compile(r"(per common share|per common|per share|shares?|amounts?)$", re.I)
SHOUT = re.compile(r"[A-Z&\s]+")


def lines(words: DataFrame, by: list[str], page: str = "page_idx", top: str = "top", x: str = "x0", right: str = "x1", text: str = "text") -> DataFrame:
    """by, order, line, tokens (array of t, x, c: text, left edge, centre) of every line that counts."""
    word = F.struct(F.col(x).alias("x"), ((F.col(x) + F.col(right)) / 2).alias("c"), F.btrim(text).alias("t"))
    grouped = words.groupBy(*by, page, F.bround(top, 1).alias("_top")).agg(F.array_sort(F.collect_list(word)).alias("tokens"))
    named = grouped.select(*by, F.struct(page, "_top").alias("order"), F.array_join("tokens.t", " ").alias("line"), F.filter("tokens", lambda w: (w["t"] != "") & ~w["t"].isin(N.CURRENCY)).alias("tokens"))
    return named.filter(~N.skipped_line(F.btrim("line")) & (F.size("tokens") > 0))


def column_centres(positions: list[float], count: int) -> list[float]:
    """``count`` centres: means of so many even slices of the positions, bounds rounded half to even."""
    n = len(positions)
    out = []
    for i in range(count):
        low = min(round(i * n / count), n - 1)
        part = positions[low : max(round((i + 1) * n / count), low + 1)]
        out.append(sum(part) / len(part))
    return out if n > 1 else positions * count


def composed(header: list[list[tuple[str, float]]], numbers: list[tuple[str, float]]) -> list[str]:
    """Names of the columns of ``numbers`` from the header lines above: groups of tokens spread evenly, or tokens by the nearest column."""
    parts: list[list[str]] = [[] for _ in numbers]
    nearest = lambda c: min(range(len(numbers)), key=lambda i: abs(numbers[i][1] - c))
    for line in header:
        if any("unaudited" in t.lower() for t, _ in line):
            continue
        groups = [[line[0]]]
        for before, now in zip(line, line[1:]):
            if abs(now[1] - before[1]) > GROUP_GAP:
                groups.append([])
            groups[-1].append(now)
        each, rest = divmod(len(parts), len(groups))
        if each and not rest:
            for i, group in enumerate(groups):
                for column in parts[i * each : (i + 1) * each]:
                    column += [t for t, _ in group]
        else:
            for t, c in line:
                parts[nearest(c)].append(t)
    for t, c in numbers:
        parts[nearest(c)].append(t)
    return [" ".join(p).strip() or t for p, (t, _) in zip(parts, numbers, strict=True)]


def _streamed(df: DataFrame, by: list[str], columns: list[str], run, schema: str) -> DataFrame:
    dealt = df.repartition(*by).sortWithinPartitions(*by, "order").select(*by, "order", *columns)
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return dealt.mapInPandas(run, f"{keys}, {schema}")


def _statements(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[tuple | None, pd.Series | None]]:
    """(key, line) of all lines in order; a line of None ends a statement."""
    now = None
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            key = tuple(None if pd.isna(k) else k for k in row[: len(by)])
            if now is not None and key != now:
                yield now, None
            now = key
            yield key, row
    if now is not None:
        yield now, None


def headers(marked: DataFrame, by: list[str]) -> DataFrame:
    """by, names, centres, body: the columns of each statement, and the order of its first line below the header.

    The first line with a number of four characters or more names the columns, by the dates it holds or with
    the header lines above it; later lines of the header that hold dates or years name them anew.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh = lambda: {"above": [], "names": None, "at": {}, "body": None}
        now, rows = fresh(), []
        for key, line in _statements(batches, by):
            if line is None:
                if now["names"]:
                    order = sorted(now["at"].items(), key=lambda x: x[1])
                    names, centres = (list(x) for x in zip(*order, strict=True)) if now["dated"] else (now["names"], now["centres"])
                    rows.append([*key, names, centres, now["body"]])
                now = fresh()
                if len(rows) > 1000:
                    yield pd.DataFrame(rows, columns=[*by, "names", "centres", "body"])
                    rows = []
                continue
            if now["body"] is not None:
                continue
            numbers = [(t["clean"], t["c"]) for t in line.tokens if t["numeric"]]
            labels = [t for t in line.tokens if not t["numeric"]]
            if now["names"] is None:
                if any(len(t) >= 4 for t, _ in numbers):
                    dates = list(line.dates)
                    names = dates if dates and len(dates) <= len(numbers) else composed(now["above"], numbers)
                    centres = column_centres([c for _, c in numbers], len(names))
                    now |= {"names": names, "centres": centres, "at": dict(zip(names, centres, strict=True)), "dated": False}
                else:
                    now["above"].append([(t["t"], t["c"]) for t in line.tokens])
                continue
            found = list(line.periods)
            if found:
                where = [c for _, c in numbers] or [t["c"] for t in labels] or [t["c"] for t in line.tokens]
                now["at"] |= dict(zip(found, column_centres(where, len(found)), strict=True))
                now["dated"] = True
            elif labels and numbers:
                now["body"] = line.order
        if rows:
            yield pd.DataFrame(rows, columns=[*by, "names", "centres", "body"])

    kind = marked.schema["order"].dataType.simpleString()
    found = _streamed(marked, by, ["tokens", "dates", "periods"], run, f"names array<string>, centres array<double>, body {kind}")
    return found.withColumn("names", F.when(F.exists("names", lambda x: x.endswith(",")), N.merged_fragments(F.col("names"))).otherwise(F.col("names")))


def marked_lines(found: DataFrame) -> DataFrame:
    """Lines with their tokens' kinds, and the dates and period names that they hold."""
    kinds = F.transform("tokens", lambda w: F.named_struct(F.lit("t"), w["t"], F.lit("x"), w["x"], F.lit("c"), w["c"], F.lit("numeric"), N.numeric_token(w["t"]), F.lit("clean"), N.clean_number(w["t"]), F.lit("note"), N.footnote_token(w["t"])))
    return found.select("*", F.regexp_extract_all("line", F.lit("(?i)" + R.FULL_DATE), 1).alias("dates"), N.period_labels(F.col("line")).alias("periods")).withColumn("tokens", kinds)


def labelled(marked: DataFrame, columns: DataFrame, by: list[str], reach: float = REACH) -> DataFrame:
    """Lines of the body: order, line, label (cleaned), x0, numbers (cleaned tokens near a column), filled (one of them has a value), restarts (a line of units)."""
    at = columns.select(*[F.col(c).alias(f"h_{c}") for c in by], "centres", F.size("names").alias("width"), "body")
    body = marked.join(at, [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in by]).filter(F.col("order") >= F.col("body"))
    body = body.withColumn("restarts", F.exists("tokens", lambda w: w["numeric"]) & F.contains(F.lower("line"), F.lit("in millions")))
    near = lambda w: F.coalesce(F.array_min(F.transform("centres", lambda c: F.abs(c - w["c"]))) <= reach, F.lit(False))
    first = F.coalesce(F.array_min(F.transform("tokens", lambda w, i: F.when(w["numeric"], i))), F.size("tokens"))
    told = F.filter("tokens", lambda w, i: F.when(w["numeric"], ~near(w) & ~w["note"]).otherwise((i < first) | w["t"].rlike("[A-Za-z]")))
    # words before the numbers, then strays among the numbers, then words behind them
    index = F.transform("tokens", lambda w, i: F.named_struct(F.lit("part"), F.when(w["numeric"], 1).when(i < first, 0).otherwise(2), F.lit("i"), i, F.lit("w"), w))
    held = F.filter(F.array_sort(index), lambda p: F.exists(told, lambda w: (w["x"] == p["w"]["x"]) & (w["t"] == p["w"]["t"])))
    core = lambda t: F.btrim(t, F.lit(",;:"))
    opened = body.withColumn("_all", held)
    held = F.filter("_all", lambda p: (core(p["w"]["t"]) != "") & ~core(p["w"]["t"]).rlike(r"^[\d$,().-]+$"))
    opened = opened.withColumn("_held", held).withColumn("_held", F.when(F.size("_held") > 0, F.col("_held")).otherwise(F.col("_all")))
    opened = opened.withColumn("numbers", F.transform(F.filter("tokens", lambda w: w["numeric"] & near(w)), lambda w: w["clean"]))
    begin = F.array_min(F.transform("_held", lambda p, i: F.when(~F.lower(p["w"]["t"]).isin("and", "of", "the"), i)))
    opened = opened.withColumn("_held", F.slice("_held", F.greatest(F.coalesce(begin, F.size("_held") - 1) + 1, F.lit(1)), F.greatest(F.size("_held"), F.lit(1))))
    x0 = F.coalesce(F.array_min(F.transform("_held", lambda p: p["w"]["x"])), F.col("tokens")[0]["x"])
    label = W.clean_label(F.array_join(F.transform("_held", lambda p: p["w"]["t"]), " "))
    filled = F.exists("numbers", lambda n: A.parse_number(n).isNotNull())
    return opened.select(*by, "order", "line", label.alias("label"), x0.alias("x0"), (F.size("_held") > 0).alias("worded"), "numbers", filled.alias("filled"), "restarts", "width")


def rows(body: DataFrame, by: list[str]) -> DataFrame:
    """by, order_index, label, x0, cells, raw: lines put together to rows.

    Label and numbers make a row. A label alone goes to the row before it if that has no value yet (or is
    about shares), takes numbers that wait, or waits for them; numbers alone fill a waiting label or wait.
    Dashes are numbers without a value. A line of units ends all waiting.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*by, "order_index", "label", "x0", "cells", "raw"]
        done: list[list] = []
        last: list | None = None  # the last row may still change
        nth, waits, numbers, full, waiting_full = 0, False, None, False, False

        def opened(key: tuple, line, cells, filled: bool) -> list:
            nonlocal last, nth, full
            if last is not None:
                done.append(last)
            nth += 1
            full = filled
            last = [*key, nth, line.label, line.x0, list(cells), line.line]
            return last

        def joined(text: str, raw: str) -> None:
            last[-4], last[-1] = f"{last[-4]} {text}", f"{last[-1]} {raw}"

        for key, line in _statements(batches, by):
            if line is None:
                done += [last] if last is not None else []
                last, nth, waits, numbers = None, 0, False, None
                if len(done) > 1000:
                    yield pd.DataFrame(done, columns=names)
                    done = []
                continue
            if line.restarts:
                waits, numbers = False, None
                continue
            cells, worded = list(line.numbers), bool(line.worded)
            if worded and cells:
                if waits and SHARE.search(line.line):
                    joined(line.label, line.line)
                    last[-2], full = cells, bool(line.filled)
                elif line.label:
                    opened(key, line, cells, bool(line.filled))
                else:
                    continue
                waits, numbers = False, None
            elif worded and line.label:
                alone = last is not None and numbers is None and not waits and not SHOUT.fullmatch(line.label)
                if alone and (not full or SHARE_END.search(line.label)):
                    if "accompanying notes" not in line.label.lower():
                        joined(line.label, line.line)
                else:
                    opened(key, line, numbers or [], numbers is not None and waiting_full)
                    waits, numbers = numbers is None, None
            elif cells and waits:
                last[-2], waits, full = cells, False, bool(line.filled)
                last[-1] = f"{last[-1]} {line.line}"
            elif cells:
                numbers, waiting_full = cells, bool(line.filled)
        if done:
            yield pd.DataFrame(done, columns=names)

    return _streamed(body, by, ["line", "label", "x0", "worded", "numbers", "filled", "restarts"], run, "order_index int, label string, x0 double, cells array<string>, raw string")


def statement_blocks(words: DataFrame, by: list[str], statement: str = "statement", page: str = "page_idx") -> DataFrame:
    """by, title, original_units, scale, units_assumption, audited, source: what the first page of each statement says of it.

    ``source``: all its pages, counted from one. Pages without words do not count.
    """
    w = F.struct(F.bround("top", 1).alias("top"), F.col("x0").alias("x"), F.btrim("text").alias("t"))
    pages = words.groupBy(*by, page).agg(F.array_sort(F.collect_list(w)).alias("w"))
    # a token that starts a line brings the line's end before it
    text = F.array_join(F.transform("w", lambda x, i: F.concat(F.when(i == 0, "").when(F.get(F.col("w"), i - 1)["top"] == x["top"], " ").otherwise("\n"), x["t"])), "")
    first = pages.select(*by, page, text.alias("text")).groupBy(*by).agg(F.min_by("text", page).alias("text"), F.array_sort(F.collect_set(page)).alias("pages"))
    unit = first.withColumn("_u", A.units(F.col("text")))
    source = F.array_join(F.transform("pages", lambda p: F.concat(F.lit("p."), (p + 1).cast("string"))), ", ")
    return unit.select(
        *by, N.statement_title(F.col(statement), F.col("text"), N.TITLE_LINES).alias("title"), F.col("_u.label").alias("original_units"), F.col("_u.scale").alias("scale"),
        F.col("_u.assumption").alias("units_assumption"), N.audited(F.col("text"), N.UNSTATED_AUDIT).alias("audited"), source.alias("source"),
    )


def table_rows(words: DataFrame, by: list[str], statement: str = "statement", scale: Column | float | None = None, aliases: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """by, order_index, level, label, raw, reasons, col_ord, column, raw_column, duration, period_end, value: facts of all statements in ``words``.

    Labels are those that no rule changes any more (``relabel.settled``, with ``aliases`` and ``rules``); ``reasons``: why one is doubted.
    Values are in millions by the units on a statement's first page, or times ``scale``. Columns without
    a number in a row give rows with a null value; statements without a header give none.
    """
    marked = marked_lines(lines(words, by))
    columns = written(headers(marked, by), "headers")
    made = rows(labelled(marked, columns, by), by).withColumn("label", W.clean_label(F.col("label"))).filter("label <> ''")
    made = written(made, "rows")
    # columns, levels (clusters of left edges) and units of each statement, in one look-up
    edges = made.groupBy(*by).agg(S.levels(F.collect_set(F.bround("x0", 1))).alias("edges"))
    heads = columns.select(*by, "names").join(edges, _same(columns, edges, by)).select(*[columns[c].alias(f"h_{c}") for c in by], "names", "edges")
    if scale is None:
        units = statement_blocks(words, by, statement)
        heads = heads.join(units.select(*[F.col(c).alias(f"u_{c}") for c in by], "scale"), [F.col(f"h_{c}").eqNullSafe(F.col(f"u_{c}")) for c in by]).drop(*[f"u_{c}" for c in by])
    else:
        heads = heads.withColumn("scale", scale if isinstance(scale, Column) else F.lit(float(scale)))
    table = made.join(heads, [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in by]).drop(*[f"h_{c}" for c in by])
    table = table.withColumn("values", A.fit_columns(F.transform("cells", lambda c: A.parse_number(c)), F.size("names"))).withColumn("level", F.least(S.nearest_column(F.col("x0"), F.col("edges")), F.lit(2)).cast("int"))
    table = settled(table.select(*by, "order_index", "level", "label", "raw", "values", "names", "scale"), by, statement=statement, aliases=aliases, rules=rules)
    cells = F.arrays_zip(F.col("names").alias("raw_column"), F.col("values").alias("value"))
    each = table.select(*by, "order_index", W.level_of(F.col("label"), F.col("level")).alias("level"), "label", "raw", "reasons", "scale", F.size("names").alias("_n"), F.posexplode(cells).alias("col_ord", "_c"))
    named = each.select(*by, "order_index", "level", "label", "raw", "reasons", "scale", "col_ord", N.column_label(F.col("_c.raw_column"), F.col("col_ord"), F.col("_n")).alias("column"), F.col("_c.raw_column").alias("raw_column"), F.col("_c.value").alias("value"))
    value = A.scaled(F.col("label"), F.col("value"), F.col("scale"))
    kind = F.col(statement)
    signed = F.when((kind == "income") & ~A.non_monetary(F.col("label")), A.income_sign(F.col("label"), value)).when(kind == "cash", A.cash_sign(F.col("label"), value)).otherwise(value)
    return named.select(*by, "order_index", "level", "label", "raw", "reasons", "col_ord", "column", "raw_column", R.duration_of(kind, F.col("column")).alias("duration"), D.period_end_text(F.col("column"), F.col("raw_column")).alias("period_end"), signed.alias("value"))


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in by])


def without_repeated_empty(table: DataFrame, by: list[str]) -> DataFrame:
    """Rows but those without any value whose label, in any case, stands in another row too."""
    row = Window.partitionBy(*by, "order_index")
    known = table.withColumn("_some", F.max(F.col("value").isNotNull()).over(row))
    copies = known.groupBy(*[F.col(c).alias(f"r_{c}") for c in by], F.lower("label").alias("r_label")).agg(F.count_distinct("order_index").alias("_rows"))
    met = known.join(copies, [*[F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in by], F.lower("label") == F.col("r_label")])
    return met.filter(F.col("_some") | (F.col("_rows") == 1)).select(*table.columns)


def complete_documents(table: DataFrame, doc: str, statements: tuple[str, ...] = ("balance", "income", "cash")) -> tuple[DataFrame, DataFrame]:
    """Rows of documents that have all statements, and an errors frame (doc, missing) of the others."""
    seen = table.groupBy(doc).agg(F.collect_set("statement").alias("seen"))
    lacks = seen.select(doc, F.array_except(F.array(*map(F.lit, statements)), "seen").alias("missing")).filter(F.size("missing") > 0)
    return table.join(lacks, doc, "left_anti"), lacks
