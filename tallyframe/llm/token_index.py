"""Token-id shards with a minimal perfect hash index.

A shard file is little-endian and raw::

    magic 8 bytes | header: 6 x int64 (id width, rows, ids, keys, levels, blocks)
    levels: levels x int64 (bits of each level, a multiple of 512)
    bits: blocks x 8 x uint64, the levels one after another
    rank directory: blocks x int64 (bits set before each block of 512)
    slots: keys x (fingerprint uint32, first row uint32, rows of the key uint32)
    row starts: (rows + 1) x int64 | row keys: rows x int64 | row key is null: rows x uint8
    ids: ids x uint16 or uint32

Rows stand in ascending key order.  A key is looked up in constant time: the first level whose
bit is set at the key's hash gives its slot, the number of bits set before that one (a stored
rank and the bits of one block); the slot's fingerprint tells a foreign key, the row's own key
makes that sure, and the slot gives the rows.

The shard directory (first and last key, rows and ids of every shard) is in the paths of the
files, so it is listed and not read. It has a row for SHARD_IDS ids: 1 in 50,000 of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import frames, scratch, written
from tallyframe.llm.encoders import library_encoder

MAGIC = b"TFIDS\x02\x00\x00"
#: Bits of a level per key that reaches it; bits of a block of the rank directory.
GAMMA, BLOCK = 2, 512
#: Ids after which a shard is closed; one document is never split.
SHARD_IDS = 4_000_000
#: Keys that are looked up in a shard at once.
LOOKUP = 100_000


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of int64 keys (finalizer of a splitmix generator)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """A minimal perfect hash of distinct keys: sizes of its levels, their bits by block, and the rank before each block."""

    sizes: list[int]
    bits: np.ndarray  # blocks x 8 uint64
    ranks: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """Bits hit by exactly one key stay, other keys go on to the next level."""
        sizes, parts, left = [], [], keys
        while len(left):
            size = -(-GAMMA * len(left) // BLOCK) * BLOCK
            at = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            once = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(once, bitorder="little").view("<u8").reshape(-1, BLOCK // 64))
            left = left[~once[at]]
        bits = np.concatenate(parts) if parts else np.zeros((0, BLOCK // 64), "<u8")
        each = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        return cls(sizes, bits, np.cumsum(each) - each)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; of a foreign key some slot or -1."""
        slot, left, begin = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        column = np.arange(BLOCK // 64)
        for i, size in enumerate(self.sizes):
            at = (mix(keys[left], i) % np.uint64(size)).astype(np.int64) + begin
            block, word, bit = at // BLOCK, at // 64 % (BLOCK // 64), (at % 64).astype(np.uint64)
            row = self.bits[block]
            own = row[np.arange(len(row)), word]
            hit = (own >> bit & np.uint64(1)).astype(bool)
            before = (np.bitwise_count(row) * (column < word[:, None])).sum(axis=1).astype(np.int64)
            before += np.bitwise_count(own & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[left[hit]] = (self.ranks[block] + before)[hit]
            left, begin = left[~hit], begin + size
        return slot


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def pack_shard(keys: list[int | None], rows: list[bytes]) -> bytes:
    """One shard of rows (ids as unsigned 32-bit bytes) whose keys ascend, nulls first."""
    n = len(rows)
    lengths = np.fromiter((len(r) // 4 for r in rows), np.int64, n)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    ids = np.frombuffer(b"".join(rows), "<u4")
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    null = np.fromiter((k is None for k in keys), np.uint8, n)
    key = np.fromiter((0 if k is None else k for k in keys), np.int64, n)
    known = np.flatnonzero(null == 0)
    distinct, first, count = np.unique(key[known], return_index=True, return_counts=True)
    index = PerfectHash.of(distinct)
    slot = index.slots(distinct)
    slots = np.zeros((len(distinct), 3), "<u4")
    slots[slot, 0] = fingerprints(distinct)
    slots[slot, 1] = known[first] if len(distinct) else 0
    slots[slot, 2] = count
    head = [MAGIC, np.array([width, n, len(ids), len(distinct), len(index.sizes), len(index.bits)], "<i8").tobytes(), np.array(index.sizes, "<i8").tobytes()]
    body = [index.bits.tobytes(), index.ranks.astype("<i8").tobytes(), slots.tobytes(), starts.astype("<i8").tobytes(), key.astype("<i8").tobytes(), null.tobytes(), ids.astype(f"<u{width}").tobytes()]
    return b"".join(head + body)


class Shard:
    """A shard file's bytes, read in place."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC:
            raise ValueError("not a token-id shard")
        at = 8

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, n, at)
            at += got.nbytes
            return got

        width, self.n, n_ids, n_keys, n_levels, n_blocks = part("<i8", 6).tolist()
        sizes = part("<i8", n_levels).tolist()
        bits = part("<u8", n_blocks * (BLOCK // 64)).reshape(-1, BLOCK // 64)
        self.index = PerfectHash(sizes, bits, part("<i8", n_blocks))
        self.slots = part("<u4", 3 * n_keys).reshape(-1, 3)
        self.starts = part("<i8", self.n + 1)
        self.keys = part("<i8", self.n)
        self.null = part("u1", self.n).astype(bool)
        self.ids = part(f"<u{width}", n_ids)

    def rows_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, rows) of each key by the index; (-1, 0) for foreign keys."""
        slot = self.index.slots(keys)
        found = slot >= 0
        found[found] = self.slots[slot[found], 0] == fingerprints(keys[found])
        first, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        first[found], count[found] = self.slots[slot[found], 1], self.slots[slot[found], 2]
        foreign = found & (self.keys[np.maximum(first, 0)] != keys) if self.n else found
        first[foreign], count[foreign] = -1, 0
        return first, count

    def row(self, i: int) -> np.ndarray:
        return self.ids[self.starts[i] : self.starts[i + 1]].astype("<u4")


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode every text and write shard files under ``path``, in ascending key order over all shards.

    One shuffle of the texts by range of the key; each task encodes its range in order and
    closes a shard after ``shard_ids`` ids.  Null texts count as empty, null keys come first, rows
    with equal keys stand together (ordered by a hash of the text, which also splits a key of very
    many rows over tasks) and share an index slot. An empty table writes no shard. Other columns are not read.

    The files are written by the text sink, which puts the bytes of a string column out as they are and
    a newline after each row: Spark has no binary sink, and tasks cannot reach every file system themselves.
    """

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = library_encoder(tokenizer), end_id.to_bytes(4, "little")
        part, number = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        rows: list[bytes] = []
        held = 0

        def closed() -> pd.DataFrame:
            known = [k for k in keys if k is not None]
            return pd.DataFrame({
                "shard": [f"{part:06d}-{number:06d}"], "nulls": [len(keys) - len(known)], "first": [str(known[0]) if known else "none"],
                "last": [str(known[-1]) if known else "none"], "ids": [held], "raw": [pack_shard(keys, rows)],
            })

        for pdf in batches:
            for k, t in zip(pdf["k"].tolist(), pdf["t"].tolist(), strict=True):
                if held >= shard_ids:
                    yield closed()
                    keys, rows, held, number = [], [], 0, number + 1
                ids = encoder.encode_one(t) + end
                keys.append(k)
                rows.append(ids)
                held += len(ids) // 4
        if keys:
            yield closed()

    ordered = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("x", F.xxhash64("t")).repartitionByRange("k", "x").sortWithinPartitions("k", "x")
    made = frames(ordered.select("k", "t"), shards, "shard string, nulls long, first string, last string, ids long, raw binary")
    written(docs.sparkSession, made.withColumn("value", F.col("raw").cast("string")).drop("raw").write.partitionBy("shard", "nulls", "first", "last", "ids"), "text", path)


@dataclass
class Directory:
    """Where keys lie: paths of the shards in key order, their first and last keys, rows without a key, and the ids before each."""

    paths: list[str]
    first: np.ndarray
    last: np.ndarray
    nulls: np.ndarray
    base: np.ndarray
    keyed: np.ndarray  # numbers of the shards that have keys

    @classmethod
    def of(cls, spark: SparkSession, path: str) -> Directory:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
        parts = [F.regexp_extract("path", f"/{name}=([^/]+)", 1).alias(name) for name in ("shard", "nulls", "first", "last", "ids")]
        rows = files.select("path", *parts).orderBy("shard").collect()
        ids = np.array([int(r["ids"]) for r in rows], np.int64)
        keyed = [i for i, r in enumerate(rows) if r["first"] != "none"]
        return cls(
            [r["path"] for r in rows], np.array([int(rows[i]["first"]) for i in keyed], np.int64), np.array([int(rows[i]["last"]) for i in keyed], np.int64),
            np.array([int(r["nulls"]) for r in rows], np.int64), np.cumsum(ids) - ids, np.array(keyed, np.int64),
        )

    def holding(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``keys``, shard) of every shard whose range holds the key: mostly one, several where a key's rows go over shards."""
        low, high = np.searchsorted(self.last, keys, "left"), np.searchsorted(self.first, keys, "right")
        n = np.maximum(high - low, 0)
        at = np.repeat(np.arange(len(keys)), n)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return at, self.keyed[low[at] + nth] if len(at) else at


_FOUND = "{key} long, shard long, start long, n_tokens long, ids_crc32 long"


def lookup(keys: DataFrame, path: str, key: str = "doc_id", nulls: bool = False) -> DataFrame:
    """Rows of the given keys: key, shard (its number), start (ids of all rows before it), n_tokens, ids_crc32.

    ``keys``: a table with column ``key``; repeated keys count once and foreign keys give no row. Only the shards whose
    range holds a key are read. ``nulls``: also give the rows that have no key.
    """
    spark = keys.sparkSession
    known = Directory.of(spark, path)
    shared = spark.sparkContext.broadcast(known)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, shard = shared.value.holding(pdf["k"].to_numpy(np.int64))
            yield pd.DataFrame({"shard": shard, "k": pdf["k"].to_numpy(np.int64)[at]})

    wanted = frames(keys.select(F.col(key).cast("long").alias("k")).filter("k is not null").distinct(), placed, "shard long, k long")
    sizes = wanted.groupBy(F.col("shard").alias("s_shard")).count()
    parts = wanted.join(sizes, F.col("shard") == F.col("s_shard")).groupBy("shard", F.pmod(F.xxhash64("k"), F.ceil(F.col("count") / LOOKUP)).alias("part")).agg(F.collect_list("k").alias("ks")).drop("part")
    if nulls and (without := np.flatnonzero(known.nulls).tolist()):
        parts = parts.union(spark.createDataFrame([(i, None) for i in without], "shard long, ks array<long>"))
    numbers = {p: i for i, p in enumerate(known.paths)}
    need = sorted(r["shard"] for r in parts.select("shard").distinct().collect())
    if not need:
        return spark.createDataFrame([], _FOUND.format(key=key))
    files = spark.read.format("binaryFile").load([known.paths[i] for i in need]).select(F.regexp_extract("path", "/shard=([^/]+)", 1).alias("name"), "content")
    names = spark.createDataFrame([(p.split("/shard=")[1].split("/")[0], numbers[p]) for p in known.paths], "n_name string, number long")
    opened = files.join(F.broadcast(names), F.col("name") == F.col("n_name")).select("number", "content")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number, raw, ks in zip(pdf["number"].tolist(), pdf["content"], pdf["ks"], strict=True):
                s = Shard(raw)
                if ks is None:
                    row = np.flatnonzero(s.null)
                    given = pd.array([None] * len(row), dtype="Int64")
                else:
                    asked = np.asarray(ks, np.int64)
                    first, count = s.rows_of(asked)
                    row = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    given = np.repeat(asked, count)
                yield pd.DataFrame({
                    key: given, "shard": number, "start": s.starts[row] + shared.value.base[number], "n_tokens": s.starts[row + 1] - s.starts[row],
                    "ids_crc32": np.fromiter((zlib.crc32(s.row(i).tobytes()) for i in row.tolist()), np.int64, len(row)),
                })

    return frames(opened.join(parts, F.col("number") == F.col("shard")).select("number", "content", "ks"), found, _FOUND.format(key=key))


def token_index(docs: DataFrame, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shards and look every document up again by its key: key, shard, start over all shards, n_tokens, ids_crc32.

    Repeated rows and rows without a key are given each; an empty table gives no rows.
    """
    path = scratch(docs.sparkSession, "token-shards")
    write_shards(docs, path, tokenizer, end_id, key, text, shard_ids)
    if not docs.select(key).head(1):
        return docs.sparkSession.createDataFrame([], _FOUND.format(key=key))
    return lookup(docs.select(key), path, key, nulls=True)
