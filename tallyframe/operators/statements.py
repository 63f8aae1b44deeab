"""Rebuilding statement tables from positioned words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import numbers as N

LEVEL_GAP, COLUMN_REACH = 3.0, 45.0
NUMERIC = re.compile(r"^[-–—]$|^\(?[$€£]?\(?[\d,.]*\d[\d,.]*\)?%?\)?$")


def lines_of(words: DataFrame, by: list[str], top: str, x: str, text: str) -> DataFrame:
    """Words with the same rounded height, left to right, as one line: by, top, tokens, xs, line."""
    word = F.struct(F.col(x).alias("x"), F.col(text).alias("t"))
    grouped = words.groupBy(*by, F.bround(top, 1).alias("top")).agg(F.array_sort(F.collect_list(word)).alias("_w"))
    return grouped.select(*by, "top", F.col("_w.t").alias("tokens"), F.col("_w.x").alias("xs"), F.array_join("_w.t", " ").alias("line"))


def levels(xs: Column, gap: float = LEVEL_GAP) -> Column:
    """Starts of clusters of positions: one farther than ``gap`` from a cluster's start opens the next."""
    xs = F.array_sort(F.array_distinct(F.transform(xs, lambda x: x.cast("double"))))
    start = F.array().cast("array<double>")
    return F.aggregate(xs, start, lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(F.concat(F.array(F.lit(0.0)), a), -1) > gap), F.concat(a, F.array(x))).otherwise(a))


def nearest_column(x: Column, centres: Column) -> Column:
    """0-based index of the closest centre; ties to the first."""
    return F.array_min(F.transform(centres, lambda c, i: F.named_struct(F.lit("d"), F.abs(c - x), F.lit("i"), i)))["i"]


def near_columns(tokens: Column, centres: Column, reach: float = COLUMN_REACH) -> Column:
    """Tokens (struct x, t) within reach of a column."""
    return F.filter(tokens, lambda w: F.array_min(F.transform(centres, lambda c: F.abs(c - w["x"]))) <= reach)


def row_machine(lines: DataFrame, by: list[str], order: str, tokens: str, columns: int) -> DataFrame:
    """Rows of a statement from its lines in order: by, order_index, label, values (array of double).

    A line with label and numbers is a row. A label alone waits for numbers; numbers alone fill
    the waiting row, or wait for the next label. Two labels in a row: the first is a heading with
    no values. Lines are dealt by statement and streamed in order, so a task holds one
    statement's state and open row, however many statements or lines it gets.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*by, "order_index", "label", "cells"]
        now: tuple | None = None
        nth, waiting, pending = 0, None, None
        for pdf in batches:
            rows: list[list] = []
            for *key, toks in zip(*[pdf[c].tolist() for c in by], pdf[tokens].tolist(), strict=True):
                if now != (key := tuple(None if pd.isna(k) else k for k in key)):
                    rows += [waiting] if waiting else []
                    now, nth, waiting, pending = key, 0, None, None
                numbers = [t for t in toks if NUMERIC.match(t)]
                label = " ".join(t for t in toks if not NUMERIC.match(t))
                if label:
                    rows += [waiting] if waiting else []
                    nth += 1
                    row = [*key, nth, label, numbers or pending or []]
                    waiting = row if not numbers and not pending else None
                    pending = pending if numbers else None
                    rows += [] if waiting else [row]
                elif numbers and waiting:
                    waiting[-1] = numbers
                    rows.append(waiting)
                    waiting = None
                elif numbers:
                    pending = numbers
            yield pd.DataFrame(rows, columns=names)
        if waiting:
            yield pd.DataFrame([waiting], columns=names)

    schema = ", ".join([f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in by] + ["order_index int", "label string", "cells array<string>"])
    found = lines.select(*by, order, tokens).repartition(*by).sortWithinPartitions(*by, order).select(*by, tokens).mapInPandas(run, schema)
    values = F.transform("cells", lambda c: N.parse_number(F.regexp_replace(F.translate(c, "–—", "--"), r"[^0-9(),.-]", "")))
    return found.select(*by, "order_index", "label", N.fit_columns(values, columns).alias("values"))
