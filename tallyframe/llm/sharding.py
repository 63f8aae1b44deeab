"""Sharding: a two-pass external shuffle of documents into shards with equal counts.

Pass one scatters the rows to buckets by a seeded hash of key and text; a bucket holds about
``bucket_bytes`` of text, however many rows there are, so one task can hold it. Pass two puts each
bucket into the order of that hash, shuffles it by Fisher-Yates with a generator seeded by seed and
bucket, and writes it. Buckets follow each other, so a row's place in all rows is known from the
counts of the buckets before its own, and shard ``s`` of ``n`` holds the places from ``s * rows // n`` on:
the law ``rows`` (counts at most one apart). Neither the partitions of the input nor those of the
shuffle change the result.

Rows that are equal in key and text would all have one hash; such rows (a table of them is made
first) are scattered by their place in the input too, so many copies of one row spread as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tallyframe.llm.common import scratch, stored, written

SHARDS, SEED = 24, 13
#: Text of a bucket, which a task holds at once.
BUCKET_BYTES = 4 << 20
#: Text of a partition of the shuffle, which Spark sorts with the disk's help and which holds many buckets.
PARTITION_BYTES = 1 << 30
#: Partitions at most; the driver gathers one count of each.
MOST_PARTITIONS = 1 << 16
#: A table of repeated rows is broadcast up to so many; a larger one is joined by a shuffle.
FEW_REPEATS = 1 << 18
#: What a row counts beyond its text.
ROW_BYTES = 8


def permutation(seed: int, bucket: int, n: int) -> np.ndarray:
    """Fisher-Yates over 0 .. n-1, drawn from the generator of this seed and bucket."""
    order = np.arange(n)
    if n > 1:
        last = np.arange(n - 1, 0, -1)
        drawn = np.random.Generator(np.random.PCG64([seed, bucket])).integers(0, last + 1)
        for i, j in zip(last.tolist(), drawn.tolist()):
            order[i], order[j] = order[j], order[i]
    return order


def scattered(docs: DataFrame, key: str, text: str, seed: int) -> DataFrame:
    """``docs`` with _h, the seeded hash of key, text and, for rows that occur again with both, their place."""
    rows = docs.withColumn("_h", F.xxhash64(F.lit(seed).cast("long"), F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")))
    again = rows.groupBy(F.col("_h").alias("_again")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_again")
    again = stored(again, "repeated")
    n = again.count()
    if not n:
        return rows
    met = rows.join(F.broadcast(again) if n <= FEW_REPEATS else again, F.col("_h") == F.col("_again"), "left")
    place = F.xxhash64("_h", F.monotonically_increasing_id())
    # written, as both passes must see the same places
    return stored(met.withColumn("_h", F.when(F.col("_again").isNull(), F.col("_h")).otherwise(place)).drop("_again"), "scattered")


def _bucket(buckets: int) -> Column:
    return F.pmod("_h", F.lit(buckets).cast("long"))


def shuffled(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` and, in shuffled order within each partition, ``shard`` (int) and ``slot`` (long, from 0).

    Columns named ``shard`` or ``slot`` are replaced, others may have any name. Null keys and null
    texts are values like others, repeated rows each get a slot, ties of the hash keep any order
    (the rows are equal), an empty table gives no rows; with fewer rows than shards some shards
    are empty.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    own = [f"_c{i}" for i in range(len(columns))]
    names = dict(zip(columns, own, strict=True))
    rows = scattered(docs.select(*[F.col(f"`{c}`").alias(o) for c, o in names.items()]), names[key], names[text], seed)
    total, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.coalesce(F.octet_length(names[text]), F.lit(0)) + F.lit(ROW_BYTES).cast("long")), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes))
    parts = min(buckets, MOST_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES))
    part = F.floor(F.col("_bucket") * parts / buckets).cast("int")
    dealt = rows.withColumn("_bucket", _bucket(buckets)).withColumn("_part", part)
    counts = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = np.concatenate([[0], np.cumsum([counts.get(p, 0) for p in range(parts)])])
    sorted_ = dealt.repartitionById(parts, F.col("_part")).sortWithinPartitions("_bucket", "_h", *[names[c] for c in (key, text)])
    fields = [StructField(o, docs.schema[c].dataType) for c, o in names.items()]
    types = StructType([*fields, StructField("shard", IntegerType()), StructField("slot", LongType())])
    cuts = np.array([s * total // shards for s in range(shards + 1)])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, at, end, held = to_arrow_schema(types), None, None, []

        def shuffle() -> Iterator[pa.RecordBatch]:
            nonlocal at, end
            table = pa.Table.from_batches(held)
            first = table.slice(0, 1).to_pydict()
            if at is None:
                at, end = starts[first["_part"][0] : first["_part"][0] + 2].tolist()
            table = table.select(own).take(permutation(seed, first["_bucket"][0], table.num_rows))
            places = np.arange(at, at + table.num_rows)
            at += table.num_rows
            shard = np.searchsorted(cuts, places, "right") - 1
            table = table.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(places - cuts[shard], pa.int64()))
            yield from table.cast(made).to_batches()

        for batch in batches:
            bucket = batch.column(batch.schema.get_field_index("_bucket")).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if held and held[-1].column(held[-1].schema.get_field_index("_bucket"))[0].as_py() != bucket[a]:
                    yield from shuffle()
                    held.clear()
                held.append(batch.slice(a, b - a))
        if held:
            yield from shuffle()
        if at != end:
            raise RuntimeError("the rows changed between the count and the shuffle")

    placed = sorted_.select(*own, "_bucket", "_part").mapInArrow(go, types)
    return placed.select(*[F.col(o).alias(c) for c, o in names.items()], "shard", "slot")


def write_shards(docs: DataFrame, path: str, **how) -> DataFrame:
    """Write the shuffled rows to folders ``shard=0``, ``shard=1``, ... under ``path``, in the order of their slots; and read them back.

    A task writes the part of each shard that its places fall into, so a shard's files in
    the order of their names hold its slots in order. A lost task is run again with the same
    result: its rows are sorted and its generators seeded.
    """
    out = shuffled(docs, **how)
    written(docs.sparkSession, out.write.partitionBy("shard"), "parquet", path)
    return docs.sparkSession.read.schema(StructType([f for f in out.schema.fields if f.name != "shard"] + [out.schema["shard"]])).parquet(path)


def placements(shards: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard of every row of written shards."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return shards.select(
        F.col(key).cast("long").alias(key), (F.octet_length(whole) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded(docs: DataFrame, **how) -> DataFrame:
    """``placements`` of all ``docs`` in shards that are written to the shared folder and read back."""
    return placements(write_shards(docs, scratch(docs.sparkSession, "shards"), **how))
