"""The long fact table: reshaping, aliases, restatements, repeated and suspect labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import labels as L

#: Aliases and similar rule tables are sent to all tasks up to this many rows.
RULES = 100_000


def unpivot(wide: DataFrame, ids: list[str], columns: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """One row per cell; empty cells stay."""
    return wide.unpivot(ids, columns, name, value)


def small(rules: DataFrame) -> DataFrame:
    """A broadcast hint where the table is known to be small."""
    return F.broadcast(rules) if rules.limit(RULES + 1).count() <= RULES else rules


def with_aliases(lines: DataFrame, aliases: DataFrame, label: str, out: str = "canonical", by: list[str] = ()) -> DataFrame:
    """``out``: the alias of the canonical label, in any case, or the canonical label itself; one look-up, not a chain."""
    own = L.canonical(F.col(label))
    rules = small(aliases.select(*[F.col(c).alias(f"_a_{c}") for c in by], F.lower(L.canonical(F.col("key"))).alias("_key"), F.col("value").alias("_value")))
    on = [F.lower(own) == F.col("_key"), *[F.col(c) == F.col(f"_a_{c}") for c in by]]
    return lines.join(rules, on, "left").withColumn(out, F.coalesce("_value", own)).drop("_key", "_value", *[f"_a_{c}" for c in by])


def latest_known(facts: DataFrame, keys: list[str], value: str, seq: list[str]) -> DataFrame:
    """The last value that is not null of each key, in order of ``seq``; null only where there is no other."""
    order = F.struct(*seq)
    last = F.max(F.when(F.col(value).isNotNull(), F.struct(order.alias("o"), F.col(value).alias("v"))))
    return facts.groupBy(*keys).agg(last.alias("_l")).select(*keys, F.col("_l.v").alias(value))


def presentation(facts: DataFrame, keys: list[str], shown: list[str], order: list[str]) -> DataFrame:
    """Attributes of each key's latest period; later rows win ties."""
    return facts.groupBy(*keys).agg(F.max_by(F.struct(*shown), F.struct(*order)).alias("_l")).select(*keys, "_l.*")


def repeated_labels(lines: DataFrame, label: str, by: list[str] = ()) -> DataFrame:
    """Labels, in any case, that stand more than once, with their number: counted before any row moves."""
    return lines.groupBy(*by, F.lower(label).alias("label")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def section_parent(lines: DataFrame, by: list[str], order: str, level: Column, label: str, levels: int = 3) -> DataFrame:
    """``parent``: the label of the last row above with a lower level, if that level is just one lower."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    held = lines.withColumn("_level", level)
    parent = F.lit(None).cast("string")
    for n in range(1, levels):
        above = F.last(F.when(F.col("_level") < n, F.struct(F.col("_level").alias("l"), F.col(label).alias("t"))), ignorenulls=True).over(w)
        parent = F.when(F.col("_level") == n, F.when(above["l"] == n - 1, above["t"])).otherwise(parent)
    return held.withColumn("parent", parent).withColumnRenamed("_level", "level")


def parent_row(lines: DataFrame, by: list[str], order: str, is_child: Column, is_parent: Column, value: str) -> DataFrame:
    """Children's values by the nearest parent row above them: by, parent order, value of the child."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    held = lines.withColumn("_parent", F.last(F.when(is_parent, F.col(order)), ignorenulls=True).over(w)).withColumn("_child", is_child)
    moved = held.filter(F.col("_child") & F.col("_parent").isNotNull())
    return moved.groupBy(*by, "_parent").agg(F.max_by(value, order).alias(value)).withColumnRenamed("_parent", "parent")


def without_existing(rows: DataFrame, existing: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose key is not among ``existing``."""
    return rows.join(existing.select(F.col(right).alias("_k")), F.col(left) == F.col("_k"), "left_anti")
