"""Hashed maximum-entropy language model with a class-factored softmax.

log P(word | history) = log P(class | history) + log P(word | class, class before).

* Classes: the end of a text; the rare words together with all unknown ones; each of the most
  frequent words by itself; and the other frequent words by cluster and band of frequency.
  Clusters come from k-means over the frequent words found beside a word; words outside the
  clustered vocabulary take the cluster most common for their last bytes.
* P(class | history) is a softmax over classes with hashed features of words: the word before (a
  bigram with the class), the one before that (a skip), and both together. Words of every frequency
  are contexts; their number of buckets follows the tokens of the corpus.
* P(word | class, class before) is a softmax over the words of the class: the word's share of
  its class, and a hashed feature of the class before with the word. Within the rare class, words
  seen once and unknown words get the mass that Good and Turing's counts of counts give them.

Texts become numbers once, in a written table, which all passes read. Both parts are trained by
distributed gradient updates over all training texts. For the classes, texts are dealt to shards by
a hash of key and text, as many as the tokens ask for; in each round every shard takes steps over its
share in the order of that hash, and a bucket's weights are averaged by how often shards met it, in
the order of the shards. So the weights follow from the texts alone, however they are partitioned. For the
words Spark counts (class before, word) pairs; every task computes observed less expected counts of
its histories, and Spark adds them up for the next step.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyframe.llm.common import discard, frames, released, slices, stored
from tallyframe.llm.language import remainder

#: Words that have a number; rarer ones are looked up by a join, and are contexts by their hash.
VOCABULARY = 300_000
#: Words that are clustered (others go by their endings); words that are classes of their own and contexts for the clusters.
CLUSTERED, SINGLE = 20_000, 14
CLUSTERS, BANDS = 6, 4
END, RARE = 0, 1
CLASSES = 2 + SINGLE + CLUSTERS * BANDS
#: Least and most buckets of history features (each with a weight for every class), and buckets of (class before, word) features.
LEAST_HASHED, HASHED, PAIRED = 1 << 12, 1 << 17, 1 << 18
#: Rounds of updates; tokens of a step; tokens of a shard in a round; step sizes.
ROUNDS, WORD_ROUNDS, STEP, SHARD, RATE, PRIOR = 3, 4, 4096, 2_000_000, 0.3, 2.0
#: Tasks of a round at most; each takes several shards, one after the other.
MOST_TASKS = 4096
#: Buckets of a block of numbers that travels as one value.
HISTORY_BLOCK, PAIR_BLOCK = 256, 1 << 14
#: Distinct keys after which a task hands on its counts; bytes of texts that are looked up at once.
FLUSH, GATHERED = 200_000, 8 << 20
#: Rows of a bucket in a step that are added up one by one with those of others; further ones are summed by bucket.
ALONGSIDE = 12
#: Numbers of the end of a text and of words that are not frequent: this one and those below.
END_CODE, RARE_CODE = -2, -3


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts (between ASCII white space, A-Z lower-cased), and where those of each text start and end."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = parts.flatten().cast(pa.binary()), parts.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    word = pc.binary_length(flat).to_numpy() > 0
    if word.all():
        return flat, ends
    return flat.filter(pa.array(word)), np.append(0, np.cumsum(word))[ends]


def word_counts(texts: DataFrame) -> DataFrame:
    """w, n of every token of column ``t``; the end of a text is the empty word."""

    def added(parts: list[pa.StructArray]) -> list[pa.StructArray]:
        sums = pa.table(pa.concat_arrays(parts).flatten(), names=["w", "n"]).group_by("w", use_threads=False).aggregate([("n", "sum")])
        return [pa.StructArray.from_arrays([sums.column(c).combine_chunks() for c in ("w", "n_sum")], names=["w", "n"])]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = [], 0
        for part in batches:
            counts = pc.value_counts(split(part.column(0))[0])
            held.append(pa.StructArray.from_arrays(counts.flatten(), names=["w", "n"]))
            ends += part.num_rows
            if sum(map(len, held)) > 2 * FLUSH:
                held = added(held)
                if len(held[0]) > FLUSH:
                    yield pa.RecordBatch.from_struct_array(held[0])
                    held = []
        if held:
            yield pa.RecordBatch.from_struct_array(added(held)[0])
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], names=["w", "n"])

    return streams(texts, count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def frequent(vocabulary: DataFrame, most: int) -> tuple[list[tuple[bytes, int]], int]:
    """Words seen ``least`` times or more, most frequent first: at most ``most`` of them, and ``least`` (2 or more)."""
    kinds = vocabulary.filter("w <> X''").groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.count(F.lit(1)).alias("words"))
    least, held = (1 << 20) + 1, 0
    for r in kinds.orderBy(F.desc("n")).toLocalIterator():
        held += r["words"]
        if held > most or r["n"] < 2:
            break
        least = r["n"]
    rows = vocabulary.filter((F.col("n") >= least) & (F.col("w") != F.lit(b""))).toArrow()
    return sorted(zip(rows.column("w").to_pylist(), rows.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0])), least


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about GATHERED bytes, or of one row that has more."""
    held: list[pa.RecordBatch] = []
    for part in batches:
        if held and sum(b.nbytes for b in held) + part.nbytes > GATHERED:
            yield pa.concat_batches(held)
            held = []
        held.append(part)
    if held:
        yield pa.concat_batches(held)


def encoded(chosen: DataFrame, words: list[bytes]) -> DataFrame:
    """k, held_out, h, ids, missing, times of every text: numbers of its words, and those that have none with how often they occur.

    ids holds 32-bit integers as bytes.
    """
    shared = chosen.sparkSession.sparkContext.broadcast(pa.array(words, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = shared.value
        n = len(numbered)
        for part in gathered(batches):
            flat, ends = split(part.column(3))
            # the dictionary of the frequent words and these together has the frequent ones first
            named = pa.concat_arrays([numbered, flat]).dictionary_encode()
            ids, others = named.indices.to_numpy()[n:].copy(), named.dictionary.slice(n)
            rare = np.flatnonzero(ids >= n)
            other = ids[rare].astype(np.int64) - n
            codes = np.array([RARE_CODE - (zlib.crc32(w) & 0x3FFFFFFF) for w in others.to_pylist()], np.int32)
            ids[rare] = codes[other]
            # each text's words without a number, with how often they occur
            text = np.searchsorted(ends, rare, "right") - 1
            each, times = np.unique(text * (len(others) + 1) + other, return_counts=True)
            held = np.searchsorted(each // (len(others) + 1), np.arange(len(ends)))
            missing = others.take(pa.array(each % (len(others) + 1)))
            coded = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids)])
            lists = [pa.ListArray.from_arrays(pa.array(held, pa.int32()), values) for values in (missing, pa.array(times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), coded, *lists], names=["k", "held_out", "h", "ids", "missing", "times"])

    return streams(chosen.select("k", "held_out", "h", "t"), run, "k long, held_out boolean, h long, ids binary, missing array<binary>, times array<int>")


def streams(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pd.DataFrame | pa.RecordBatch]], schema: str) -> DataFrame:
    """``df`` through ``run``, which gets Arrow batches of bounded bytes and gives frames or batches."""
    types = StructType.fromDDL(schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = to_arrow_schema(types)
        for out in run(part for b in batches for part in slices(b)):
            if isinstance(out, pa.RecordBatch):
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out.columns, made)], schema=made)
            else:
                yield pa.RecordBatch.from_pandas(out, schema=made, preserve_index=False)
        released()

    return df.mapInArrow(go, types)


def listed(ids: pa.BinaryArray) -> pa.ListArray:
    """32-bit integers that each value holds as bytes."""
    edges = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] // 4
    values = pa.Array.from_buffers(pa.int32(), int(edges[-1]), [None, ids.buffers()[2] or pa.py_buffer(b"")])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)


def flattened(ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all tokens of some texts, an end behind each, and the tokens of each text (its end included)."""
    sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
    flat = np.full(int(sizes.sum()) + len(sizes), END_CODE, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    word = np.ones(len(flat), bool)
    word[ends] = False
    flat[word] = ids.flatten().to_numpy()
    return flat, sizes + 1


def neighbours(coded: DataFrame, words: int) -> np.ndarray:
    """How often each of the first ``words`` words stands right after, and right before, each of the first SINGLE: a bounded array."""
    single = min(SINGLE, words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(words * 2 * single, np.int64)
        for part in batches:
            flat, _ = flattened(listed(part.column(0)))
            a, b = flat[:-1], flat[1:]
            inside = (a >= 0) & (b >= 0) & (a < words) & (b < words)
            after, before = inside & (a < single), inside & (b < single)
            at = np.concatenate((b[after] * 2 * single + a[after], a[before] * 2 * single + single + b[before]))
            sums += np.bincount(at, minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"at": at, "n": sums[at]})

    out = np.zeros(words * 2 * single)
    rows = streams(coded.select("ids"), count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out[rows["at"].to_numpy(np.int64)] = rows["n"]
    return out.reshape(words, 2 * single)


def clustered(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """k-means by angle over square roots of shares, from the vectors that lie farthest apart."""
    x = np.sqrt(vectors / np.maximum(vectors.sum(axis=1, keepdims=True), 1))
    some = np.flatnonzero(vectors.sum(axis=1) > 0)
    if not len(some):
        return np.zeros(len(x), np.int64)
    centres = [x[some[0]]]
    pool = some[: max(200, SINGLE)]
    for _ in range(CLUSTERS - 1):
        near = np.max(x[pool] @ np.array(centres).T, axis=1)
        centres.append(x[pool[int(np.argmin(near))]])
    c = np.array(centres)
    for _ in range(20):
        label = np.argmax(x @ c.T, axis=1)
        for k in range(CLUSTERS):
            own = label == k
            if own.any():
                m = (x[own] * weights[own, None]).sum(axis=0)
                c[k] = m / max(np.linalg.norm(m), 1e-12)
    return np.argmax(x @ c.T, axis=1)


def classed(words: list[tuple[bytes, int]], cluster: np.ndarray) -> np.ndarray:
    """Class of each frequent word, most frequent first."""
    out = np.zeros(len(words), np.int64)
    endings: dict[bytes, np.ndarray] = {}
    for (w, n), k in zip(words[: len(cluster)], cluster.tolist()):
        for size in (2, 3):
            endings.setdefault(w[-size:] if len(w) >= size else b"^" + w, np.zeros(CLUSTERS))[k] += math.log1p(n)
    top = math.log(words[SINGLE][1] + 1) if len(words) > SINGLE else 1.0
    for i, (w, n) in enumerate(words):
        if i < SINGLE:
            out[i] = 2 + i
            continue
        if i < len(cluster):
            k = int(cluster[i])
        else:
            votes = endings.get(w[-3:], endings.get(w[-2:]))
            k = int(np.argmax(votes)) if votes is not None else 0
        band = min(BANDS - 1, int(BANDS * (1 - math.log(n + 1) / top) + 1e-9)) if top > 0 else 0
        out[i] = 2 + SINGLE + k * BANDS + max(0, band)
    return out


@dataclass
class Lexicon:
    """What tasks know of the frequent words, by number; the words themselves may be left out."""

    words: list[bytes]
    classes: np.ndarray
    log_share: np.ndarray  # log10 of the word's share of its class
    log_base: np.ndarray  # log10 of the base model's probability

    @cached_property
    def members(self) -> list[np.ndarray]:
        """Numbers of the words of each class, ascending."""
        order = np.argsort(self.classes, kind="stable")
        return np.split(order, np.searchsorted(self.classes[order], np.arange(1, CLASSES)))

    def kinds(self, flat: np.ndarray) -> np.ndarray:
        """Classes of tokens."""
        frequent_ = self.classes[np.maximum(flat, 0)] if len(self.classes) else np.full(len(flat), RARE)
        return np.where(flat >= 0, frequent_, np.where(flat == END_CODE, END, RARE))


def before(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers one and two places before each token; nothing reaches over the end of a text."""
    padded = np.concatenate(([END_CODE, END_CODE], flat))
    one, two = padded[1:-1].copy(), padded[:-2].copy()
    two[one == END_CODE] = END_CODE
    return one, two


def features(one: np.ndarray, two: np.ndarray, hashed: int) -> np.ndarray:
    """Hashed features of histories, a row each: the word before, the skip, and both."""
    a, b = (one + (1 << 31)).astype(np.uint64), (two + (1 << 31)).astype(np.uint64)
    with np.errstate(over="ignore"):
        raw = [a * np.uint64(3), b * np.uint64(3) + np.uint64(1), (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(3) + np.uint64(2)]
        return np.stack([(r * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - hashed.bit_length())).astype(np.int64) for r in raw], 1)


def pair_buckets(kind: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashed feature of the class before and a word."""
    with np.errstate(over="ignore"):
        return ((word.astype(np.uint64) * np.uint64(CLASSES) + kind.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(65 - PAIRED.bit_length())).astype(np.int64)


def _scores(weights: np.ndarray, f: np.ndarray, prior: np.ndarray | None, s: np.ndarray | None = None, t: np.ndarray | None = None) -> np.ndarray:
    """Scores of all classes, less the highest, for rows of features; in ``s``, with room to work in ``t``, where these are given."""
    s = np.take(weights, f[:, 0], axis=0, out=s, mode="clip")
    if prior is not None:
        s += prior
    for i in range(1, f.shape[1]):
        s += np.take(weights, f[:, i], axis=0, out=t, mode="clip")
    s -= s.max(axis=1, keepdims=True)
    return s


def log_probabilities(weights: np.ndarray, f: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    """log P(class | history) for rows of features; ``prior``: what every class has without any history."""
    s = _scores(weights, f, prior)
    return s - np.log(np.exp(s).sum(axis=1, keepdims=True))


class Room:
    """Arrays that steps of at most so many rows of ``width`` features work in, so that they need not be made anew."""

    def __init__(self, rows: int, width: int = 3, kind: type = np.float32) -> None:
        self.scores, self.more = np.empty((rows, CLASSES), kind), np.empty((rows, CLASSES), kind)
        self.own, self.sums, self.squares, self.work = (np.empty((width * rows, CLASSES), kind) for _ in range(4))


def log_probability_of(weights: np.ndarray, f: np.ndarray, kind: np.ndarray, prior: np.ndarray | None = None, room: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """``log_probabilities`` of one class a row."""
    s = _scores(weights, f, prior, *(x[: len(kind)] for x in room or ()))
    own = s[np.arange(len(kind)), kind]
    return own - np.log(np.exp(s, out=s).sum(axis=1))


def gradient(weights: np.ndarray, f: np.ndarray, kind: np.ndarray, prior: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features, and for each the gradient of the negative log-likelihood: expected less observed counts of every class."""
    ids, g, _, _ = counted_gradient(weights, f, kind, prior, Room(len(kind), f.shape[1], weights.dtype.type))
    return ids, g


def counted_gradient(weights: np.ndarray, f: np.ndarray, kind: np.ndarray, prior: np.ndarray | None, room: Room) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``gradient``, how often each bucket occurs, and its weights; the arrays of classes are those of ``room``."""
    # a bucket's rows in order: bucket and place are one number
    packed = np.sort(f.ravel().astype(np.uint64) << np.uint64(32) | np.arange(f.size, dtype=np.uint64))
    held, order = (packed >> np.uint64(32)).astype(np.int64), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.append(True, held[1:] != held[:-1])[: len(held)]
    starts = np.flatnonzero(new)
    ids, counts = held[starts], np.diff(np.append(starts, len(order)))
    local = np.empty(f.size, np.int64)
    local[order] = np.cumsum(new) - 1
    own = np.take(weights, ids, axis=0, out=room.own[: len(ids)], mode="clip")
    g = _scores(own, local.reshape(f.shape), prior, room.scores[: len(kind)], room.more[: len(kind)])
    np.exp(g, out=g)
    g /= g.sum(axis=1, keepdims=True)
    g[np.arange(len(kind)), kind] -= 1
    return ids, _by_bucket(g, order // f.shape[1], starts, counts, room.sums[: len(ids)]), counts, own


def _by_bucket(g: np.ndarray, rows: np.ndarray, starts: np.ndarray, counts: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``g`` by bucket, in ``out``: those of bucket i are ``counts[i]`` of ``rows`` from ``starts[i]`` on."""
    np.take(g, rows[starts], axis=0, out=out, mode="clip")
    # most buckets occur once: only those that occur again are summed, the most frequent first
    several = np.flatnonzero(counts > 1)
    if len(several):
        several = several[np.argsort(-counts[several], kind="stable")]
        many, first, most = -counts[several], starts[several], int(counts[several[0]])
        sums = out[several]
        for nth in range(1, min(most, ALONGSIDE)):
            upto = int(np.searchsorted(many, -nth))
            sums[:upto] += np.take(g, rows[first[:upto] + nth], axis=0)
        for i in range(int(np.searchsorted(many, -ALONGSIDE))):
            sums[i] += np.take(g, rows[first[i] + ALONGSIDE : first[i] - many[i]], axis=0).sum(axis=0)
        out[several] = sums
    return out


def _summed(blocks: DataFrame, order: list[str], kind: str, done: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> Iterator[tuple[int, np.ndarray]]:
    """``done`` of the sums, as doubles, of the arrays (binary column a, numbers of that kind) of each block in ``order``: one array a block, a partition of blocks at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        for pdf in batches:
            for block, a in zip(pdf["block"].tolist(), pdf["a"], strict=True):
                if block != now:
                    if now is not None:
                        yield pd.DataFrame({"block": [now], "a": [done(total).tobytes()]})
                    now, total = block, 0.0
                total = total + np.frombuffer(a, kind).astype(np.float64)
        if now is not None:
            yield pd.DataFrame({"block": [now], "a": [done(total).tobytes()]})

    dealt = blocks.repartition("block").sortWithinPartitions("block", *order)
    table = stored(frames(dealt.select("block", "a"), run, "block int, a binary"), "sums")
    for r in table.toLocalIterator():
        yield r["block"], r["a"]
    discard(table)


def _averaged(total: np.ndarray) -> np.ndarray:
    """Weights of a block by how often shards met its buckets; not a number for buckets that none met."""
    met = total[-HISTORY_BLOCK:, None]
    with np.errstate(invalid="ignore", divide="ignore"):
        return (total[:-HISTORY_BLOCK].reshape(HISTORY_BLOCK, CLASSES) / np.where(met > 0, met, np.nan)).astype("<f4")


def fit_classes(coded: DataFrame, lexicon, prior: np.ndarray, hashed: int, total: int) -> np.ndarray:
    """Weights of the history features after ROUNDS rounds over the training texts.

    coded: h, ids. A text's shard and round follow from its hash; a shard's steps do not depend on the task that takes them.
    """
    spark = coded.sparkSession
    weights = np.zeros((hashed, CLASSES), np.float32)
    shards = max(1, -(-total // (ROUNDS * SHARD)))
    tasks = min(shards, MOST_TASKS)
    dealt = coded.withColumn("shard", F.pmod(F.shiftright("h", 8), F.lit(shards)).cast("int")).withColumn("round", F.pmod("h", F.lit(ROUNDS)))
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast((weights, prior))

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pd.DataFrame]:
            lex, (start, bias) = lexicon.value, shared.value
            now, w, squares, met, f, kind = None, None, None, None, None, None
            room = Room(STEP)

            def take(rows: np.ndarray, own: np.ndarray) -> None:
                ids, g, n, held = counted_gradient(w, rows, own, bias, room)
                s = np.take(squares, ids, axis=0, out=room.squares[: len(ids)], mode="clip")
                s += np.multiply(g, g, out=room.work[: len(ids)])
                squares[ids] = s
                np.sqrt(s, out=s)
                g *= np.float32(RATE)
                g /= s
                held -= g
                w[ids] = held
                met[ids] += n

            def finished() -> Iterator[pd.DataFrame]:
                if len(kind):
                    take(f, kind)
                for block in np.unique(np.flatnonzero(met) // HISTORY_BLOCK).tolist():
                    at = slice(block * HISTORY_BLOCK, (block + 1) * HISTORY_BLOCK)
                    yield pd.DataFrame({"block": [block], "shard": [now], "a": [np.concatenate(((w[at] * met[at, None]).ravel(), met[at])).astype("<f4").tobytes()]})

            for part in batches:
                shard = part.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                for x, y in zip(edges, edges[1:]):
                    if shard[x] != now:
                        if now is not None:
                            yield from finished()
                        now, w, squares, met = int(shard[x]), start.copy(), np.full_like(start, 1e-6), np.zeros(hashed, np.float32)
                        f, kind = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
                    flat, _ = flattened(listed(part.column(1).slice(x, y - x)))
                    f, kind = np.concatenate((f, features(*before(flat), hashed))), np.concatenate((kind, lex.kinds(flat)))
                    whole = len(kind) // STEP * STEP
                    for i in range(0, whole, STEP):
                        take(f[i : i + STEP], kind[i : i + STEP])
                    f, kind = f[whole:], kind[whole:]
            if now is not None:
                yield from finished()

        share = dealt.filter(F.col("round") == r).repartitionById(tasks, F.pmod("shard", F.lit(tasks))).sortWithinPartitions("shard", "h").select("shard", "ids")
        weights = weights.copy()
        for block, a in _summed(streams(share, step, "block int, shard int, a binary"), ["shard"], "<f4", _averaged):
            own, new = weights[block * HISTORY_BLOCK : (block + 1) * HISTORY_BLOCK], np.frombuffer(a, "<f4").reshape(HISTORY_BLOCK, CLASSES)
            own[...] = np.where(np.isnan(new), own, new)
        shared.destroy()
    return weights


def word_events(coded: DataFrame, lexicon) -> DataFrame:
    """kind, own (the word's class), word, n: how often each frequent word that shares its class follows each class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        lex: Lexicon = lexicon.value
        held, rows = [], 0

        def given() -> pd.DataFrame:
            at, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            at, back = np.unique(at, return_inverse=True)
            return pd.DataFrame({"kind": at % CLASSES, "own": lex.classes[at // CLASSES] if len(at) else at, "word": at // CLASSES, "n": np.bincount(back, n).astype(np.int64)})

        for part in batches:
            flat, _ = flattened(listed(part.column(0)))
            before_ = np.concatenate(([END], lex.kinds(flat)[:-1]))
            several = flat >= SINGLE
            held.append(np.unique(flat[several] * CLASSES + before_[several], return_counts=True))
            rows += len(held[-1][0])
            if rows > FLUSH:
                yield given()
                held, rows = [], 0
        if held:
            yield given()

    return streams(coded.select("ids"), count, "kind int, own int, word int, n long").groupBy("kind", "own", "word").agg(F.sum("n").alias("n"))


def word_gradient(pairs: np.ndarray, lex: Lexicon, kind: int, group: int, words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words of class ``group`` after class ``kind``: buckets, observed less expected counts, and expected counts; all add up over parts of the counts."""
    own = lex.members[group]
    buckets = pair_buckets(np.full(len(own), kind), own)
    p = np.exp(lex.log_share[own] * math.log(10) + pairs[buckets])
    p /= p.sum()
    seen = np.zeros(len(own))
    seen[np.searchsorted(own, words)] = n
    expected = seen.sum() * p
    return buckets, seen - expected, expected


def fit_words(events: DataFrame, lexicon) -> np.ndarray:
    """Weights of the (class before, word) features: each round every task adds up gradients of its histories, and the driver takes a damped Newton step."""
    spark = events.sparkSession
    pairs = np.zeros(PAIRED)
    for _ in range(WORD_ROUNDS):
        shared = spark.sparkContext.broadcast(pairs)

        def step(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            lex: Lexicon = lexicon.value
            parts = list(batches)  # at most CLASSES rows for each word of the vocabulary, over all tasks
            if not parts:
                return
            pdf = pd.concat(parts)
            g, e = np.zeros(PAIRED), np.zeros(PAIRED)
            for (kind, own), rows in pdf.groupby(["kind", "own"], sort=False):
                rows = rows.sort_values("word")
                buckets, less, expected = word_gradient(shared.value, lex, int(kind), int(own), rows["word"].to_numpy(), rows["n"].to_numpy())
                g += np.bincount(buckets, less, PAIRED)
                e += np.bincount(buckets, expected, PAIRED)
            for block in np.unique(np.flatnonzero(e) // PAIR_BLOCK).tolist():
                at = slice(block * PAIR_BLOCK, (block + 1) * PAIR_BLOCK)
                yield pd.DataFrame({"block": [block], "a": [np.concatenate((g[at], e[at])).tobytes()]})

        pairs = pairs.copy()
        for block, a in _summed(frames(events, step, "block int, a binary"), [], "<f8"):
            a = np.frombuffer(a, "<f8")
            own = pairs[block * PAIR_BLOCK : (block + 1) * PAIR_BLOCK]
            own += np.clip((a[:PAIR_BLOCK] - PRIOR * own) / (a[PAIR_BLOCK:] + PRIOR), -1, 1)
        shared.destroy()
    return pairs


def normalisers(lex: Lexicon, pairs: np.ndarray) -> np.ndarray:
    """log10 of the sum over the words of each class (columns) after each class (rows)."""
    out = np.zeros((CLASSES, CLASSES))
    for group, own in enumerate(lex.members):
        for kind in range(CLASSES if group >= 2 + SINGLE and len(own) else 0):
            out[kind, group] = math.log10(np.exp(lex.log_share[own] * math.log(10) + pairs[pair_buckets(np.full(len(own), kind), own)]).sum())
    return out


def word_scores(lex: Lexicon, pairs: np.ndarray, norm: np.ndarray, flat: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """log10 P(word | class, class before) of frequent words that share their class; zero for others."""
    out, before_ = np.zeros(len(flat)), np.concatenate(([END], kind[:-1]))
    at = np.flatnonzero(flat >= SINGLE)
    w, k = flat[at], before_[at]
    out[at] = lex.log_share[w] + pairs[pair_buckets(k, w)] / math.log(10) - norm[k, kind[at]]
    return out


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 10, held: int = 0, vocabulary: int = VOCABULARY) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learns from documents whose crc32(key as text) mod ``modulus`` is not ``held``; a null key
    counts as an empty text there and null texts are empty. Repeated rows count and are scored
    each, other columns are ignored and an empty table gives no rows. Unknown words count as one
    symbol in both models. Words beyond the ``vocabulary`` most frequent (words of one count are in it together or not at
    all, words seen once never) have the rare class, share it by their counts, and are contexts like any other word.
    """
    out = remainder(F.col(key), modulus) == held
    k, t = F.col(key).cast("long"), F.coalesce(F.col(text), F.lit(""))
    chosen = docs.select(k.alias("k"), out.alias("held_out"), F.xxhash64(k, t).alias("h"), t.alias("t"))
    spark = docs.sparkSession
    counts = stored(word_counts(chosen.filter(~F.col("held_out")).select("t")), "vocabulary")
    total, distinct, once, twice = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("n"), F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).first())
    ends = counts.filter("w = X''").first()
    ends = ends["n"] if ends else 0
    words, least = frequent(counts, vocabulary)
    coded = stored(encoded(chosen, [w for w, _ in words]), "numbers")
    training = coded.filter(~F.col("held_out")).select("h", "ids")
    some = min(len(words), CLUSTERED)
    near = neighbours(training, some) if some else np.zeros((0, 1))
    cluster = clustered(near, np.array([n for _, n in words[:some]], float)) if some else np.zeros(0, np.int64)
    kinds = classed(words, cluster)
    seen = np.array([n for _, n in words], float)
    del words, near  # the driver keeps numbers only
    of_class = np.bincount(kinds, weights=seen, minlength=CLASSES) if len(seen) else np.zeros(CLASSES)
    log_sum = math.log10(total + 0.1 * (distinct + 1))
    lexicon = spark.sparkContext.broadcast(Lexicon([], kinds, np.log10(seen / of_class[kinds]) if len(seen) else seen, np.log10(seen + 0.1) - log_sum))
    hashed = min(HASHED, max(LEAST_HASHED, 1 << total.bit_length()))
    rare = total - ends - int(seen.sum())
    mass = of_class + np.bincount([END, RARE], [ends, rare], CLASSES) + 0.5
    prior = np.log(mass / mass.sum()).astype(np.float32)
    weights = spark.sparkContext.broadcast((fit_classes(training, lexicon, prior, hashed, total), prior))
    pairs = fit_words(stored(word_events(training, lexicon).repartition("kind", "own"), "events"), lexicon)
    inner = spark.sparkContext.broadcast((pairs, normalisers(lexicon.value, pairs)))
    # the rare class: known words by count, words seen once by twice the words seen twice, and all unknown ones
    known_mass = float(rare - once + 2 * twice)
    unknown = min(1 - 1e-6, max(1e-6, once / max(once + known_mass, 1.0))) if known_mass > 0 else (1.0 if not once else 0.5)
    of_once = 2.0 * twice / once if once and twice else 1.0
    mass = known_mass if twice else float(rare)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        lex: Lexicon = lexicon.value
        bases = np.concatenate((lex.log_base, [0.0, math.log10(ends + 0.1) - log_sum, 0.0]))  # END_CODE counts from the end; rare words come later
        room = np.empty((STEP, CLASSES), np.float32), np.empty((STEP, CLASSES), np.float32)
        for part in batches:
            flat, sizes = flattened(listed(part.column(2)))
            kind, starts = lex.kinds(flat), np.cumsum(sizes) - sizes
            own, f = word_scores(lex, *inner.value, flat, kind), features(*before(flat), hashed)
            for i in range(0, len(kind), STEP):
                own[i : i + STEP] += log_probability_of(weights.value[0], f[i : i + STEP], kind[i : i + STEP], weights.value[1], room) / math.log(10)
            tally = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
            sums = [sizes, tally((flat >= 0).astype(np.int64)) + (ends > 0), tally(bases[np.maximum(flat, RARE_CODE)]), tally(own)]
            columns = [part.column(0), part.column(1), *map(pa.array, sums), part.column(3), part.column(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "held_out", "n_tokens", "known", "base", "score", "missing", "times"])

    made = streams(coded.select("k", "held_out", "ids", "missing", "times"), first, "k long, held_out boolean, n_tokens long, known long, base double, score double, missing array<binary>, times array<int>")
    part = stored(made.withColumn("row", F.monotonically_increasing_id()), "scores")
    scarce = counts.filter((F.col("n") < least) & (F.col("w") != F.lit(b""))).select(F.col("w").alias("s_w"), "n")
    each = part.select("row", F.explode(F.arrays_zip("missing", "times")).alias("m")).select("row", F.col("m.missing").alias("w"), F.col("m.times").alias("times")).join(scarce, F.col("w") == F.col("s_w"), "left")
    n = F.col("n")
    in_class = F.when(n.isNull(), F.lit(math.log10(unknown))).otherwise(F.log10(F.lit(1 - unknown if mass else 1.0) * F.when(n == 1, F.lit(of_once)).otherwise(n) / F.lit(mass or 1.0)))
    times = F.col("times")
    rest = each.groupBy("row").agg(F.sum(F.when(n.isNotNull(), times)).alias("r_known"), F.sum(times * (F.log10(F.coalesce(n, F.lit(0)) + 0.1) - log_sum)).alias("r_base"), F.sum(times * in_class).alias("r_score"))
    zero = F.lit(0.0)
    return part.join(rest, "row", "left").select(
        F.col("k").alias(key), "held_out", "n_tokens", (F.col("known") + F.coalesce("r_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("r_score", zero)).alias("score"),
    )
