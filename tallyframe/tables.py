"""Tables that a job writes between its steps, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; in local mode without that setting, below a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.gettempdir() + f"/tallyframe-{spark.sparkContext.applicationId}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: what follows does not compute it again, and lost executors lose nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Partitions of a numbering sort at most; the driver gathers one count of each.
MOST_PARTITIONS = 1 << 16


def numbered(rows: DataFrame, order: list[Column | str], name: str = "nth") -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2, ... in ``order``; equal rows in any order.

    The sort is written with each row's partition and place in it; the places get the counts of the partitions before.
    """
    spark = rows.sparkSession
    parts = min(MOST_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    before, base = 0, []
    for r in sorted(held.groupBy("_part").count().collect()):
        base.append((r["_part"], before))
        before += r["count"]
    starts = spark.createDataFrame(base, "_at int, _base long")
    return held.join(F.broadcast(starts), F.col("_part") == F.col("_at")).withColumn(name, F.col("_base") + F.col("_nth")).drop("_part", "_nth", "_at", "_base")
