"""Connected components by alternating large-star and small-star rounds over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of every node, or itself: partial minima before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to its least neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = stored(_least(both), "star")
    tied = both.join(m, "u").filter(F.col("v") > F.col("u"))
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = stored(_least(down), "star")
    tied = down.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = m.select("u", F.col("m").alias("v"))
    return tied.union(own).filter("u <> v").distinct()


def connected(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node that has a link.

    ``links``: two long columns; self links are ignored, repeated links do no harm, and no
    links give no rows. Each half round is written to the shared folder, and rounds end when
    the table of links no longer changes; their number grows with the logarithm of the longest path.
    """
    a, b = links.columns[:2]
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "links")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = None
    while True:
        now = state(edges)
        if now == last or not now[0]:
            break
        last = now
        edges = stored(_small_star(stored(_large_star(edges), "large")), "small")
    return stored(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct()), "roots")
