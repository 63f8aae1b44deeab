"""Label review: requests, suggestions by a pluggable client, and usage totals."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIPPED = ("", "total", "subtotal")
WAIT = re.compile(r"try again in ([\d.]+)\s*s", re.I)
REPLY = "normalized_label string, justification string, confidence string"


def requests(lines: DataFrame, statement: Column, label: Column, values: Column, reasons: Column, keys: list[str]) -> DataFrame:
    """keys and ``request``: the JSON that a reviewer gets. ``values``: a map from period to number."""
    body = F.struct(statement.alias("statement"), label.alias("label"), reasons.alias("reasons"), values.alias("values"))
    return lines.filter(F.size(reasons) > 0).select(*keys, F.to_json(body).alias("request"))


def echo(request: str) -> str:
    """The offline reviewer: gives back the label as it is, without a confidence."""
    import json

    label = json.loads(request)["label"]
    return json.dumps({"normalized_label": label, "justification": "offline"})


def asked_wait(message: str) -> float | None:
    """Seconds that a server asks to wait in its message."""
    found = WAIT.search(message)
    return float(found.group(1)) if found else None


def reviewed(asked: DataFrame, keys: list[str], client: Callable[[str], str] = echo, attempts: int = 3, delay: float = 4.0) -> DataFrame:
    """keys, reply (null where every attempt failed). Only rows with requests reach Python, in Arrow batches."""

    def ask(request: str) -> str | None:
        for k in range(attempts):
            try:
                return client(request)
            except Exception as e:
                if k + 1 < attempts:
                    time.sleep(asked_wait(str(e)) or delay * 2**k + random.random())
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(reply=[ask(r) for r in pdf["request"]]).drop(columns=["request"])

    schema = ", ".join([f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in keys] + ["reply string"])
    return asked.select(*keys, "request").mapInPandas(run, schema)


def suggestions(replies: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, justification, confidence: replies that hold a label; a confidence that is no number is null."""
    text = F.coalesce(F.nullif(F.regexp_extract("reply", r"(?s)\{.*\}", 0), F.lit("")), F.col("reply"))
    parsed = replies.select(*keys, F.from_json(text, REPLY).alias("r"))
    label = F.btrim("r.normalized_label")
    return parsed.filter(F.length(label) > 0).select(*keys, label.alias("label"), F.col("r.justification").alias("justification"), F.col("r.confidence").try_cast("double").alias("confidence"))


def confident(rows: DataFrame, least: float, confidence: str = "confidence") -> DataFrame:
    """Rows without a confidence pass."""
    return rows.filter(F.col(confidence).isNull() | (F.col(confidence) >= least))


def usage(events: DataFrame, by: list[str], tokens: str, cost: str) -> DataFrame:
    """Totals: tokens with null as zero; cost only if every event has one; cost of those that have one."""
    return events.groupBy(*by).agg(
        F.sum(F.coalesce(tokens, F.lit(0))).alias("tokens"),
        F.when(F.count(F.lit(1)) == F.count(cost), F.sum(cost)).alias("strict_cost"),
        F.sum(cost).alias("known_cost"),
    )


def estimated_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost by prices a million tokens; null if anything is."""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def usage_events(replies: DataFrame, keys: list[str], model: str, price_in: float | None = None, price_out: float | None = None) -> DataFrame:
    """An event for each reply, or failed request: kind, model, tokens (four characters each where the reply does not say), cost, note."""
    said = F.from_json("reply", "usage struct<input_tokens: long, output_tokens: long>")["usage"]
    out = F.coalesce(said["output_tokens"], F.ceil(F.length("reply") / 4))
    cost = estimated_cost(said["input_tokens"], out, F.lit(price_in).cast("double"), F.lit(price_out).cast("double"))
    failed = F.col("reply").isNull()
    return replies.select(
        *keys, F.lit("label_review").alias("kind"), F.lit(model).alias("model"), said["input_tokens"].alias("input_tokens"), out.alias("output_tokens"),
        (said["input_tokens"] + out).alias("total_tokens"), cost.alias("estimated_cost_usd"), F.when(failed, "request failed").alias("note"),
    )


def applied(rows: DataFrame, given: DataFrame, keys: list[str], label: str = "label", reasons: str = "reasons") -> DataFrame:
    """``rows`` with the suggested labels in place and ``llm_normalized`` among the reasons of changed ones; skipped labels and foreign rows stay."""
    at = given.select(*[F.col(c).alias(f"g_{c}") for c in keys], F.col("label").alias("_given")).dropDuplicates([f"g_{c}" for c in keys])
    met = rows.join(at, [F.col(c) == F.col(f"g_{c}") for c in keys], "left").drop(*[f"g_{c}" for c in keys])
    new = F.when(~F.lower(F.btrim(label)).isin(*SKIPPED), F.col("_given"))
    changed = new.isNotNull() & (new != F.col(label))
    return met.withColumn(reasons, F.when(changed, F.array_append(F.coalesce(F.col(reasons), F.array().cast("array<string>")), "llm_normalized")).otherwise(F.col(reasons))).withColumn(label, F.coalesce(new, F.col(label))).drop("_given")


def suggestion_totals(given: DataFrame, by: list[str]) -> DataFrame:
    """by, suggestions, with_confidence, mean_confidence."""
    return given.groupBy(*by).agg(F.count(F.lit(1)).alias("suggestions"), F.count("confidence").alias("with_confidence"), F.avg("confidence").alias("mean_confidence"))
