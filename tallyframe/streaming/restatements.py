"""Facts that arrive as a stream of files: later filings restate earlier ones.

The target is a log of runs. A batch writes one run that holds its own keys only, each with its last known value, so what it
writes follows the batch, not the target. Every FAN runs of one level become one run of the next, so a
value is written again once a level, and a target of n batches has at most FAN - 1 runs on each of log(n) levels.
What is known is the last value over all runs of the newest manifest.

A manifest (the list of runs that count) is written after its runs and named by the batch, and a batch starts from
the newest manifest before its own: one that is run again, after a failure at any point, writes
the same runs and the same manifest again. Order of arrival does not matter: the value of the greatest ``seq``
counts, of equal ones the greater value.
"""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyframe.operators.facts import latest_known

#: Runs of a level that become one of the next.
FAN = 8


def reduced(rows: DataFrame, keys: list[str], value: str, seq: list[str]) -> DataFrame:
    """keys, value, seq: the last known value of each key; keys without any value have no row."""
    last = F.max(F.struct(F.struct(*seq).alias("o"), F.col(value).alias("v")))
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(last.alias("_l")).select(*keys, F.col("_l.v").alias(value), *[F.col(f"_l.o.{c}").alias(c) for c in seq])


class Log:
    """Runs and manifests below a folder in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, target: str) -> None:
        self.spark, self.target = spark, target.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.target}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def manifests(self) -> list[int]:
        """Batches that were committed."""
        done = [n for n in self._names("manifests") if self._fs.exists(self._path(f"{self.target}/manifests/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("batch=")) for n in done)

    def runs(self, batch: int | None = None) -> list[dict]:
        """level and name of the runs that count after ``batch`` (after the last one)."""
        known = [n for n in self.manifests() if batch is None or n <= batch]
        if not known:
            return []
        rows = self.spark.read.text(f"{self.target}/manifests/batch={known[-1]}").collect()
        return [json.loads(r["value"]) for r in rows]

    def commit(self, batch: int, runs: list[dict]) -> None:
        lines = self.spark.createDataFrame([(json.dumps(r),) for r in runs], "value string").coalesce(1)
        lines.write.mode("overwrite").text(f"{self.target}/manifests/batch={batch}")

    def write(self, rows: DataFrame, level: int, batch: int) -> dict:
        name = f"level={level}-batch={batch}"
        rows.write.mode("overwrite").parquet(f"{self.target}/runs/{name}")
        return {"level": level, "name": name}

    def read(self, runs: list[dict], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.target}/runs/{r['name']}" for r in runs])

    def tidy(self, batch: int) -> None:
        """Remove what neither this batch's manifest nor the one before names: a reader of that one is not cut off."""
        keep = self.manifests()[-2:]
        named = {r["name"] for n in keep for r in self.runs(n)}
        for n in self._names("manifests"):
            if int(n.removeprefix("batch=")) < keep[0]:
                self._fs.delete(self._path(f"{self.target}/manifests/{n}"), True)
        for n in self._names("runs"):
            if n not in named and int(n.rpartition("=")[2]) <= batch:
                self._fs.delete(self._path(f"{self.target}/runs/{n}"), True)


def merge(batch: DataFrame, number: int, target: str, keys: list[str], value: str, seq: list[str], fan: int = FAN) -> None:
    """Add one batch to the log: its own run, and a run of the next level wherever ``fan`` of one have come together."""
    log = Log(batch.sparkSession, target)
    rows = reduced(batch.select(*keys, value, *seq), keys, value, seq)
    runs = [*log.runs(number - 1), log.write(rows, 0, number)]
    level = 0
    while len(full := [r for r in runs if r["level"] == level]) >= fan:
        met = reduced(log.read(full, rows.schema), keys, value, seq)
        runs = [*[r for r in runs if r["level"] != level], log.write(met, level + 1, number)]
        level += 1
    log.commit(number, runs)
    log.tidy(number)


def latest_facts(
    spark: SparkSession, source: str, schema: str | StructType, target: str, checkpoint: str, keys: list[str], value: str, seq: list[str],
    fan: int = FAN, files: int | None = None, where: Column | None = None,
) -> StreamingQuery:
    """Add all files that arrived at ``source`` (their rows that ``where`` holds for) to the log at ``target``, at most ``files`` a batch. ``current`` reads what is known."""
    read = spark.readStream.schema(schema)
    stream = (read.option("maxFilesPerTrigger", files) if files else read).parquet(source)
    stream = stream if where is None else stream.filter(where)
    add = partial(merge, target=target, keys=keys, value=value, seq=seq, fan=fan)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, schema: str | StructType, keys: list[str], value: str, seq: list[str], batch: int | None = None) -> DataFrame:
    """keys and the last known value of each, as of the last batch or an earlier one that is still kept. No batches: no rows."""
    log = Log(spark, target)
    whole = spark.createDataFrame([], schema).select(*keys, value, *seq).schema
    runs = log.runs(batch)
    rows = log.read(runs, whole) if runs else spark.createDataFrame([], whole)
    return reduced(rows, keys, value, seq).select(*keys, value)


def as_batch(facts: DataFrame, keys: list[str], value: str, seq: list[str]) -> DataFrame:
    """The same result over a whole table."""
    return latest_known(facts, keys, value, seq).filter(F.col(value).isNotNull())
