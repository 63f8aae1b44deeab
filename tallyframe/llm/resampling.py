"""Importance resampling toward a target distribution over hashed word features.

Texts become a sparse matrix of documents by buckets: how often each hashed feature occurs. Spark
keeps it in the shared folder as blocks of compressed sparse rows (a row a block: the keys, the
row pointers, the bucket numbers and the counts of some hundred documents). The column sums of the
blocks are the distribution of the raw documents, those of the target's blocks the distribution of the
target; a bucket's gain is the logarithm of the ratio of both, smoothed and rounded down to
thousandths. The weight of a document is its row times the vector of gains, and adding seeded Gumbel
noise makes the documents of highest score a draw without replacement by those weights.

Only vectors as long as the number of buckets, a parameter, pass through the driver. Scores are
ranked by a sort of Spark's, whose partitions are counted; no rank has to fit in a task.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import frames, stored

BUCKETS, SEED, SHARE, MIN_WORDS = 10_000, 2024, 10, 20
#: Documents of a block, and counts after which a block ends earlier.
BLOCK_ROWS, BLOCK_COUNTS = 512, 1 << 18
#: What words are made of once A-Z are lower case (fixed: digits, letters and all beyond ASCII).
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Words whose bucket a worker remembers.
REMEMBERED = 1 << 17
#: Partitions of the ranking sort at most; the driver gathers one count of each.
MOST_PARTITIONS = 1 << 16
_BLOCK = "keys array<long>, n_words array<long>, starts array<int>, buckets array<int>, counts array<int>"
_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())


def words(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").translate(_FOLD))


def features(text: str, longest: int) -> tuple[int, Counter]:
    """How many words, and how often every run of 1 to ``longest`` words occurs."""
    ws = words(text)
    found = Counter(ws)
    for n in range(2, longest + 1):
        found.update(b" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1))
    return len(ws), found


def blocks(docs: DataFrame, key: str, text: str, buckets: int, longest: int) -> DataFrame:
    """The count matrix of ``docs`` as blocks of compressed sparse rows; a null key stays null, a null text is an empty row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}

        def block() -> pd.DataFrame:
            return pd.DataFrame({"keys": [keys], "n_words": [sizes], "starts": [starts], "buckets": [np.concatenate(columns)], "counts": [np.concatenate(counts)]})

        keys, sizes, starts, columns, counts = [], [], [0], [], []
        for batch in batches:
            for k, t in zip(batch["k"], batch["t"]):
                size, found = features(t, longest)
                if len(known) > REMEMBERED:
                    known.clear()
                at = np.empty(len(found), np.int32)
                for i, f in enumerate(found):
                    b = known.get(f)
                    if b is None:
                        b = known[f] = zlib.crc32(f) % buckets
                    at[i] = b
                column, where = np.unique(at, return_inverse=True)
                keys.append(k)
                sizes.append(size)
                starts.append(starts[-1] + len(column))
                columns.append(column)
                counts.append(np.bincount(where, np.fromiter(found.values(), float, len(found)), len(column)).astype(np.int32))
                if len(keys) >= BLOCK_ROWS or starts[-1] >= BLOCK_COUNTS:
                    yield block()
                    keys, sizes, starts, columns, counts = [], [], [0], [], []
        if keys:
            yield block()

    chosen = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    return frames(chosen, run, _BLOCK)


def column_sums(matrix: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all rows: a vector a task, then a sum by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            at, n = b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()
            sums += np.bincount(at, n, buckets).astype(np.int64)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], names=["bucket", "n"])

    parts = matrix.select("buckets", "counts").mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(((t + 1) * (S + buckets)) / ((s + 1) * (T + buckets)))) of each bucket, in doubles."""
    n, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + n) / ((x + 1.0) * (t + n)))) for x, y in zip(raw.tolist(), target.tolist())], np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of the matrix: its product with the vector of gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, size, starts, at, n = (b.column(j)[i].values for j in range(5))
                starts, n = starts.to_numpy(), n.to_numpy().astype(np.int64)
                # running sums, so that empty rows come out as zero
                total, count = (np.concatenate([[0], np.cumsum(x)])[starts] for x in (n * gain[at.to_numpy()], n))
                yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), size.cast(pa.int64()), pa.array(np.diff(count)), pa.array(np.diff(total))], names=["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number of this seed and key, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank``, 1, 2, 3, ... by ``order``; rows that ``order`` leaves equal come in any order.

    Rows are sorted across partitions with their place as last key, so equal ones may part. The sort is
    written with each row's partition and place in it, and the places get the counts of the
    partitions before: a number each, of 65,536 partitions at most.
    """
    spark = rows.sparkSession
    parts = min(MOST_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(parts, *order, "_place").sortWithinPartitions(*order, "_place").drop("_place")
    held = stored(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranked")
    counts = sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.cumsum([0, *[n for _, n in counts]])
    base = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(counts, before)], "_at int, _base long")
    return held.join(F.broadcast(base), F.col("_part") == F.col("_at")).withColumn("rank", F.col("_base") + F.col("_nth") + 1).drop("_part", "_nth", "_at", "_base")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = 1,
    seed: int = SEED, share: int = SHARE, min_words: int = MIN_WORDS,
) -> DataFrame:
    """key, n_features, weight, score, rank (all long) of every document; ``rank`` of the drawn ones, null for others.

    Of the N documents with ``min_words`` words or more, the ``share`` per cent of highest score are drawn, rounded
    down. Null texts have no features and weight 0; a null key has the noise of an empty one
    and comes after others of its score; repeated rows are documents of their own, and those equal in score,
    key, weight and features share any order. Other columns are ignored. An empty table gives no rows;
    an empty target has equal smoothed counts in all buckets.
    """
    matrix = stored(blocks(docs, key, text, buckets, longest), "matrix")
    aim = stored(blocks(target.select(F.lit(None).cast("long").alias("k"), F.col(f"`{target_text}`").alias("t")), "k", "t", buckets, longest), "target")
    gain = gains(column_sums(matrix, buckets), column_sums(aim, buckets))
    scored = stored(weights(matrix, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    enough = F.col("n_words") >= min_words
    drawn = share * scored.filter(enough).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    first = ranked(scored.filter(enough), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).select(F.col("doc_id").alias(key), "n_features", "weight", "score", "rank")


def oracle() -> str:
    """DuckDB SQL for ``resample`` of documents toward benchmark with the default parameters; crc32 by its table of 256 remainders."""
    step = "lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = "xor(list_reduce(list_transform(range(1, length(hex(encode(w))) // 2 + 1), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i - 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, r[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
    folded = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = rf"regexp_extract_all({folded}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH remainders AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), {step}, CAST(i AS BIGINT))) AS r),
    d AS (SELECT row_number() OVER () AS row, doc_id, {found} AS ws FROM documents),
    dw AS (SELECT row, unnest(ws) AS w FROM d), bw AS (SELECT unnest({found}) AS w FROM benchmark),
    hashed AS (SELECT w, {crc} % {BUCKETS} AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), remainders),
    raw AS (SELECT b, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY b), aim AS (SELECT b, count(*) AS t FROM bw JOIN hashed USING (w) GROUP BY b),
    g AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + {BUCKETS}.0::DOUBLE) / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM bw) + {BUCKETS}.0::DOUBLE)))) AS BIGINT) AS gain FROM raw LEFT JOIN aim USING (b)),
    w AS (SELECT row, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN hashed USING (w) JOIN g USING (b) GROUP BY row),
    scored AS (SELECT row, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (row)),
    drawn AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS rank FROM scored WHERE n_features >= {MIN_WORDS} QUALIFY rank <= {SHARE} * count(*) OVER () // 100)
    SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (row)"""
