"""SimHash near-duplicate groups by a segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments of two bits. The embedding is the vector of
their bit counts (0, 1 or 2). The Manhattan distance of two embeddings is never above the Hamming
distance of the fingerprints, so a range join under Manhattan distance finds every link.

Grid: the vector is cut into ``G`` groups of segments. Two embeddings within ``radius`` lie within
``t = radius // G`` in one group at least. For each group every point enters its own cell of the
grid (its counts) and all neighbour cells within ``ceil(t / 2)``; two points within ``t`` meet in
the middle, in a cell that both enter. Within a cell pairs are compared by Manhattan distance, then
verified exactly. ``G`` follows the number of points: it changes the cost, never the links.

Equal fingerprints are one point. A cell gives the links of a spanning forest, not its pairs; a
cell of many points is dealt to several tasks as pairs of slices.

``deduplicate`` decides by the similarity of shingle sets. The sets' fingerprints meet in the same range join first, and
the sets check what it links. Sets as similar as asked may differ in more bits than a range join can reach, so
another way finds the rest: cells of least hashes say which sets can have a partner at all; a set meets
the first set of a cell; sets that this leaves in different groups meet by prefixes: two sets as similar
as asked share a shingle among the few rarest of each. The places of the first one that they share bound
what they can have in common, and the buckets that hold an odd number of shingles of one set and an even one
of the other bound in how many they differ, so families of like texts that are not similar enough
are ruled out where they meet. The sets themselves decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from tallyframe.llm.common import frames, stored
from tallyframe.llm.components import connected

SEED = 42
SEGMENTS = 32
#: Points of a cell that one task compares with each other.
SLICE = 8192
#: Least hashes of a shingle set in a sketch; bands of so many of them make its cells.
LEAST, BAND = 256, 6
#: Buckets in which shingles are counted to tell rare ones from frequent ones.
COUNTED = 1 << 20
#: Differing bits at which fingerprints of shingle sets meet; up to 5 cost no more cells than op2's 4.
REACH = 5
#: Bits, by parity, that bound from below in how many shingles two sets differ.
PARITY = 512
#: Rows of one prefix shingle that one task compares; cells and groups that are broadcast up to so many.
TOGETHER, FEW = 1024, 1 << 18
#: Pairs that one copy of a shingle set is compared in.
PAIRS = 64


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], k: int) -> list[int]:
    """XXH64 of every run of ``k`` words joined by spaces, repeats included; of all words if there are fewer."""
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= k:
        return [digest(joined, SEED)]
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-1]]]
    return [digest(joined[i:j], SEED) for i, j in zip(starts, ends[k - 1 :])]


def votes(hashes: list[list[int]]) -> np.ndarray:
    """Fingerprints: a bit is set if it is set in over half of a document's hashes; none: zero."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    flat = np.fromiter((h for hs in hashes for h in hs), np.uint64, int(sizes.sum()))
    starts = (np.cumsum(sizes[some]) - sizes[some]).astype(np.int64)
    bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    out[some] = np.packbits(counts * 2 > sizes[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def set_vote(shingles: np.ndarray) -> int:
    """The fingerprint of a set of shingle hashes, as a signed long."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int32) * 2 > len(shingles), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``k`` (the key) and ``fp`` (the fingerprint as a signed long) of every document; null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, held, group = [], 0, []
            for t in pdf["t"].tolist():
                group.append(shingle_hashes(words_of(t), words))
                held += len(group[-1])
                if held > 200_000:
                    out.append(votes(group))
                    held, group = 0, []
            out.append(votes(group))
            yield pd.DataFrame({"k": pdf["k"], "fp": np.concatenate(out).view(np.int64)})

    return frames(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), run, "k long, fp long")


_LOW = 0x5555555555555555


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def embedded(fp: Column) -> Column:
    """The counts of all segments, two bits each."""
    next_ = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseXOR(next_).bitwiseAND(_long(_LOW)).bitwiseOR(F.shiftleft(fp.bitwiseAND(next_).bitwiseAND(_long(_LOW)), 1))


def neighbours(cell: Column, segments: int) -> Column:
    """The cell itself and all cells with one count one higher or lower."""
    out = [cell]
    for i in range(segments):
        count = F.shiftrightunsigned(cell, 2 * i).bitwiseAND(_long(3))
        out.append(F.when(count < 2, cell.bitwiseXOR(_long(1 << 2 * i))))  # 0 to 1, 1 to 0
        out.append(F.when(count > 0, cell.bitwiseXOR(_long(3 << 2 * i))))  # 1 to 2, 2 to 1
    return F.array_compact(F.array(*out))


def groups_for(points: int, radius: int) -> int:
    """Groups of the grid for which entering and comparing so many points is cheapest.

    Two random fingerprints have equal counts in a segment with probability 3/8. A row that enters
    a cell is taken to cost as much as 200 comparisons.
    """

    def cost(groups: int) -> float:
        size, steps = SEGMENTS // groups, -(-(radius // groups) // 2)
        cells = sum((1.5 * size) ** i / (i or 1) for i in range(steps + 1))
        return groups * cells * (200 + points * cells * 0.375**size / 2)

    return min((1, 2, 4), key=cost)


def cells_entered(points: DataFrame, groups: int, radius: int) -> DataFrame:
    """fp, table, cell of all cells that the points ``fp`` enter."""
    size, steps = SEGMENTS // groups, -(-(radius // groups) // 2)
    out = None
    for g in range(groups):
        own = F.shiftrightunsigned(embedded(F.col("fp")), 2 * size * g).bitwiseAND(_long((1 << 2 * size) - 1))
        placed = points.select("fp", own.alias("cell"))
        for step in range(steps):
            placed = placed.select("fp", F.explode(neighbours(F.col("cell"), size)).alias("cell"))
            placed = placed.distinct() if step else placed
        placed = placed.select("fp", F.lit(g).alias("table"), "cell")
        out = placed if out is None else out.union(placed)
    return out


def cell_links(cell: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """Rows (a, b) of a spanning forest of the links within each cell; ``cell`` ascends."""
    n = len(cell)
    low = np.uint64(_LOW)
    # counts in unary (00, 01, 11): the differing bits of two such words are their Manhattan distance
    unary = ((fp | fp >> np.uint64(1)) & low) | ((fp & fp >> np.uint64(1) & low) << np.uint64(1))
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    ends = np.append(starts[1:], n)
    left = np.repeat(ends, ends - starts) - np.arange(n)  # rows from here to the cell's end
    label = np.arange(n)
    links = []
    at, d = np.arange(n), 1
    while True:
        at = at[left[at] > d]
        if not len(at):
            break
        i = at[label[at] != label[at + d]]
        i = i[np.bitwise_count(unary[i] ^ unary[i + d]) <= radius]
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
        if len(i):
            for x, y in zip(i.tolist(), (i + d).tolist(), strict=True):
                a, b = x, y
                while label[a] != a:
                    a = int(label[a])
                while label[b] != b:
                    b = int(label[b])
                if a != b:
                    label[max(a, b)] = min(a, b)
                    links.append((x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
        d += 1
    return np.array(links, np.int64).reshape(-1, 2)


def links(points: DataFrame, radius: int, groups: int) -> DataFrame:
    """Links that span the same components as all pairs of ``points.fp`` (distinct) within ``radius`` bits: a, b."""
    cells = cells_entered(points.select("fp"), groups, radius)
    # cells of more than SLICE points: at most points * cells of a point / SLICE of them
    large = cells.groupBy(F.col("table").alias("l_table"), F.col("cell").alias("l_cell")).count().filter(F.col("count") > SLICE)
    joined = cells.join(large, (F.col("table") == F.col("l_table")) & (F.col("cell") == F.col("l_cell")), "left")
    slices = F.coalesce(F.ceil(F.col("count") / SLICE), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), slices).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), slices - 1), lambda x: F.least(x, own) * slices + F.greatest(x, own))
    dealt = joined.select("fp", "table", "cell", F.explode(pairs).alias("pair"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(group: pd.DataFrame) -> pd.DataFrame:
            change = np.zeros(len(group), np.int64)
            change[1:] = (np.diff(group["table"]) != 0) | (np.diff(group["cell"]) != 0) | (np.diff(group["pair"]) != 0)
            fp = group["fp"].to_numpy()
            pairs = cell_links(np.cumsum(change), fp.view(np.uint64), radius)
            return pd.DataFrame({"a": fp[pairs[:, 0]], "b": fp[pairs[:, 1]]}).drop_duplicates()

        held: list[pd.DataFrame] = []
        for pdf in batches:
            # the last cell of a batch may go on in the next
            key = pdf[["table", "cell", "pair"]].to_numpy()
            tail = (key == key[-1]).all(axis=1)
            if tail.all():
                held.append(pdf)
                continue
            cut = int(np.flatnonzero(~tail)[-1]) + 1
            yield found(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
            held = [pdf.iloc[cut:]]
        if held:
            yield found(pd.concat(held, ignore_index=True))

    together = dealt.repartition("table", "cell", "pair").sortWithinPartitions("table", "cell", "pair", "fp")
    return frames(together, run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest key reachable by links) of every row.

    Fingerprints link at ``radius`` or fewer differing bits. Null texts count as empty; a
    document without words has fingerprint zero and is linked like any other. Repeated rows
    are kept, rows with a null key belong to their component without naming it (a component of
    null keys only has a null id), other columns are ignored and an empty table gives no rows.
    """
    fps = stored(fingerprints(docs, words, key, text), "fingerprints")
    points = stored(fps.groupBy("fp").agg(F.min("k").alias("first")), "points")
    roots = connected(links(points.select("fp"), radius, groups_for(points.count(), radius)))
    rooted = points.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.join(least, "root").select(F.col("fp").alias("p_fp"), "component_id"), "components")
    return fps.join(named, F.col("fp") == F.col("p_fp")).select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_MULTIPLIERS = np.random.default_rng(11).integers(0, 1 << 31, LEAST, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Different shingle hashes of a text, ascending."""
    return np.unique(np.array(shingle_hashes(words_of(text), words), np.uint64))


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each of LEAST hashes: two sets agree on each with the probability of their Jaccard similarity."""
    x, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(LEAST, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 1024):
            np.minimum(out, (_MULTIPLIERS[:, None] * x[None, i : i + 1024]).min(axis=1), out=out)
    return out


def cells_of(least: np.ndarray) -> np.ndarray:
    """A cell for each band of BAND least hashes: sets of similarity 0.8 share none of the 42 with a probability of 3 in a million."""
    bands = least[:, : LEAST // BAND * BAND].reshape(len(least), -1, BAND).astype(np.uint64)
    cell = np.arange(bands.shape[1], dtype=np.uint64)[None, :].repeat(len(least), 0)
    with np.errstate(over="ignore"):
        for i in range(BAND):
            cell = (cell ^ bands[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
            cell ^= cell >> np.uint64(29)
    return cell.view(np.int64)


def sketches(keyed: DataFrame, words: int) -> DataFrame:
    """k, h (the row's identity), node (of its shingle set), vote (its fingerprint), cells and the sketch fp0, ..., one bit of each least hash; no cells without shingles."""
    lanes = [f"fp{i}" for i in range(LEAST // 64)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_set(t, words) for t in pdf["t"].tolist()]
            least = np.stack([least_hashes(x) for x in sets])
            with np.errstate(over="ignore"):
                bits = (least * np.uint32(0x85EBCA6B)) >> np.uint32(31)
            fp = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<i8")
            node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            cells = [c if len(x) else c[:0] for c, x in zip(cells_of(least), sets)]
            yield pd.DataFrame({"k": pdf["k"], "h": pdf["h"], "node": node, "vote": [set_vote(x) for x in sets], "cells": cells} | {c: fp[:, i] for i, c in enumerate(lanes)})

    return frames(keyed, run, "k long, h long, node long, vote long, cells array<long>, " + ", ".join(f"{c} long" for c in lanes))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """node, s (its different shingle hashes) of the rows (node, t)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "s": [shingle_set(t, words).view(np.int64) for t in pdf["t"].tolist()]})

    return frames(texts, run, "node long, s array<long>").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least that Jaccard similarity; sets in many pairs are dealt as copies to several tasks."""
    few = F.broadcast if pairs.count() <= FEW else lambda x: x
    copies = pairs.groupBy(F.col("a").alias("c_node")).agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("copies"))
    left = sets.join(few(copies), F.col("node") == F.col("c_node")).select(F.col("node").alias("l_node"), F.col("s").alias("x"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    right = sets.select(F.col("node").alias("r_node"), F.col("s").alias("y"))
    named = pairs.select("a", "b").join(few(copies), F.col("a") == F.col("c_node"))
    dealt = right.join(few(named), F.col("b") == F.col("r_node")).withColumn("own", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    both = dealt.join(left, (F.col("a") == F.col("l_node")) & (F.col("own") == F.col("copy"))).withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.filter(F.col("common") / (F.size("x") + F.size("y") - F.col("common")) >= similarity).select("a", "b")


def _few(table: DataFrame, most: int = FEW) -> DataFrame:
    """Sent to all tasks where a count shows that it is small."""
    return F.broadcast(table) if table.count() <= most else table


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each bucket: a vector a task, summed by Spark; orders shingles, and decides nothing else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(COUNTED, np.int64)
        for pdf in batches:
            flat = np.concatenate([np.asarray(x, np.int64) for x in pdf["s"]]).view(np.uint64)
            sums += np.bincount((flat % np.uint64(COUNTED)).astype(np.int64), minlength=COUNTED)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"bucket": at, "n": sums[at]})

    out = np.zeros(COUNTED, np.int64)
    rows = frames(sets.select("s"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def parity(shingles: np.ndarray) -> np.ndarray:
    """PARITY bits: whether the set has an odd number of shingles in each bucket. Two sets differ in at least as many shingles as these bits differ."""
    buckets = np.bincount((shingles >> np.uint64(65 - PARITY.bit_length())).astype(np.int64), minlength=PARITY)
    return np.packbits((buckets & 1).astype(np.uint8), bitorder="little").view("<i8")


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """node, size, tokens: the rarest shingles of each set in order, as many as a set of that similarity must share one of; odd0, ...: ``parity`` of the set.

    All sets order shingles alike: by how many sets hold their bucket, then by value.
    """
    counts = sets.sparkSession.sparkContext.broadcast(shingle_counts(sets))
    lanes = [f"odd{i}" for i in range(PARITY // 64)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = counts.value
        for pdf in batches:
            tokens, odd = [], []
            held = [np.asarray(x, np.int64).view(np.uint64) for x in pdf["s"]]
            for x in held:
                keep = len(x) - math.ceil(similarity * len(x) - 1e-9) + 1
                order = np.lexsort((x, often[(x % np.uint64(COUNTED)).astype(np.int64)]))[: min(keep, len(x))]
                tokens.append(x[order].view(np.int64))
                odd.append(parity(x))
            bits = np.stack(odd)
            yield pd.DataFrame({"node": pdf["node"], "size": [len(x) for x in held], "tokens": tokens} | {c: bits[:, i] for i, c in enumerate(lanes)})

    return frames(sets, run, "node long, size int, tokens array<long>, " + ", ".join(f"{c} long" for c in lanes))


def crossing_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """a, b, ra, rb, d of nodes of different roots that share a prefix shingle and can, by sizes, places and parities, have the similarity.

    rows: ``prefixes`` with root. ``d``: differing bits of the parities. The rows of a frequent shingle are dealt as pairs of slices.
    """
    lanes = [c for c in rows.columns if c.startswith("odd")]
    odd = rows.select(F.col("node").alias("p_node"), *lanes)
    rows = rows.select("node", "root", "size", F.posexplode("tokens").alias("place", "token"))
    kinds = rows.groupBy(F.col("token").alias("m_token")).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("rows"))
    mixed = stored(kinds.filter("low <> high").select("m_token", "rows"), "mixed")
    parts = F.ceil(F.col("rows") / TOGETHER).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    slots = F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.least(x, own) * parts + F.greatest(x, own))
    held = rows.join(_few(mixed, 4 * FEW), F.col("token") == F.col("m_token")).join(_few(odd), F.col("node") == F.col("p_node"))
    dealt = stored(held.select("token", "node", "root", "size", "place", *lanes, own.alias("own"), (own * parts + own).alias("alone"), F.explode(slots).alias("slot")), "dealt")
    other = dealt.select(*[F.col(c).alias(f"o_{c}") for c in dealt.columns])
    met = dealt.join(other, (F.col("token") == F.col("o_token")) & (F.col("slot") == F.col("o_slot")) & (F.col("node") < F.col("o_node")) & (F.col("root") != F.col("o_root")))
    # two rows of one slice meet where that slice meets itself, and nowhere else
    met = met.filter((F.col("own") != F.col("o_own")) | (F.col("slot") == F.col("alone")))
    needed = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("size") + F.col("o_size")) - 1e-9)
    most = F.least(F.col("size") - F.col("place"), F.col("o_size") - F.col("o_place"))
    far = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"o_{c}"))) for c in lanes), F.lit(0))
    # of the shingles of both, 2 * needed at least are shared; the others are no fewer than the differing bits
    can = met.filter((F.least("size", "o_size") >= F.greatest("size", "o_size") * similarity - 1e-9) & (most >= needed) & (F.col("size") + F.col("o_size") - far >= 2 * needed))
    pairs = can.select(F.col("node").alias("a"), F.col("o_node").alias("b"), F.least("root", "o_root").alias("ra"), F.greatest("root", "o_root").alias("rb"), far.alias("d"))
    return stored(pairs.distinct(), "crossing")


def fingerprint_pairs(points: DataFrame) -> DataFrame:
    """a, b of nodes whose fingerprints (``vote``) the range join links within REACH bits, or that share one."""
    held = stored(points.groupBy("vote").agg(F.min("node").alias("hub")), "votes")
    met = links(held.select(F.col("vote").alias("fp")), REACH, groups_for(held.count(), REACH))
    left, right = (held.select(F.col("vote").alias(f"{c}_vote"), F.col("hub").alias(f"{c}_hub")) for c in "ab")
    near = met.join(left, F.col("a") == F.col("a_vote")).join(right, F.col("b") == F.col("b_vote")).select("a_hub", "b_hub")
    same = points.join(left, F.col("vote") == F.col("a_vote")).filter("node <> a_hub").select("a_hub", "node")
    return stored(near.union(same).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "met")


def similar_components(points: DataFrame, sets: DataFrame, met: DataFrame, shared: DataFrame, similarity: float) -> DataFrame:
    """node, root of every node that has a link: two nodes link if their sets have the similarity.

    Four rounds, each over the pairs that the ones before left in different components: pairs that fingerprints link (``met``); a node with
    the nearest of the first nodes of its cells; of each two components the nearest pair that prefixes
    allow; all pairs that they allow.
    """

    def rooted(df: DataFrame, node: str, name: str, roots: DataFrame) -> DataFrame:
        named = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        return df.join(named, F.col(node) == F.col("_n"), "left").withColumn(name, F.coalesce("_r", node)).drop("_n", "_r")

    lanes = [c for c in points.columns if c.startswith("fp")]
    hubs = points.select(F.col("node").alias("h_node"), *[F.col(c).alias(f"h_{c}") for c in lanes])
    d = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"h_{c}"))) for c in lanes), F.lit(0))
    close = stored(verified(met, sets, similarity), "similar")
    roots = connected(close)
    apart = rooted(rooted(shared.filter("hub <> node"), "node", "ra", roots), "hub", "rb", roots).filter("ra <> rb").select("node", "hub")
    near = apart.join(points.select("node", *lanes), "node").join(hubs, F.col("hub") == F.col("h_node")).withColumn("d", d)
    first = stored(near.groupBy("node").agg(F.min(F.struct("d", "hub")).alias("one")).select(F.col("one.hub").alias("a"), F.col("node").alias("b")), "pairs")
    found = stored(close.union(verified(first, sets, similarity)), "similar")
    roots = connected(found)
    crossing = crossing_pairs(rooted(stored(prefixes(sets, similarity), "prefixes"), "node", "root", roots), similarity)
    nearest = stored(crossing.groupBy("ra", "rb").agg(F.min(F.struct("d", "a", "b")).alias("one")).select("one.a", "one.b"), "pairs")
    found = stored(found.union(verified(nearest, sets, similarity)), "similar")
    roots = connected(found)
    rest = rooted(rooted(crossing.select("a", "b").join(nearest, ["a", "b"], "left_anti"), "a", "ra", roots), "b", "rb", roots).filter("ra <> rb").select("a", "b")
    return connected(found.union(verified(stored(rest, "pairs"), sets, similarity)))


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` with all columns, one of each group of near-duplicates: the one with the least key.

    Documents link if the Jaccard similarity of their sets of different shingles is at least
    ``similarity``, which has to be 0.8 or more for the cells that tell which sets can have a partner.
    A group is what links connect. Null keys come before all others; a row is known by its key and
    its text, so rows of equal keys are kept or dropped each by its own group; of rows equal in both, the one whose
    other columns (those of plain types) hash least stays. Null texts are empty and near-duplicates of each other.
    """
    own = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    content = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    keyed = docs.select(own.alias("k"), content.alias("h"), F.col(text).alias("t"))
    rows = stored(sketches(keyed, words), "sketches")
    lanes = [c for c in rows.columns if c.startswith("fp")]
    points = stored(rows.groupBy("node").agg(F.min(F.struct("k", "h")).alias("least"), *[F.first(c).alias(c) for c in ("vote", "cells", *lanes)]), "points")
    placed = points.select("node", F.explode("cells").alias("cell"))
    several = placed.groupBy(F.col("cell").alias("s_cell")).agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub <> last").select("s_cell", "hub")
    shared = stored(placed.join(_few(stored(several, "cells")), F.col("cell") == F.col("s_cell")).select("node", "hub").distinct(), "shared")
    met = fingerprint_pairs(points.filter(F.size("cells") > 0))
    partners = shared.select("node").union(met.select("a")).union(met.select("b")).distinct()
    wanted = partners.join(points.select("node", "least"), "node").select("node", F.col("least.k").alias("w_k"), F.col("least.h").alias("w_h"))
    texts = keyed.join(_few(stored(wanted, "wanted")), (F.col("k") == F.col("w_k")) & (F.col("h") == F.col("w_h"))).select("node", "t")
    sets = stored(shingle_sets(texts, words), "sets")
    roots = similar_components(points, sets, met, shared, similarity).select(F.col("node").alias("r_node"), "root")
    grouped = points.join(roots, F.col("node") == F.col("r_node"), "left").groupBy(F.coalesce("root", "node")).agg(F.min("least").alias("one"))
    chosen = stored(grouped.select(F.col("one.k").alias("_k"), F.col("one.h").alias("_h")), "chosen")
    names = [f"_{i}" for i in range(len(docs.columns))]
    at, said = (F.col(names[docs.columns.index(c)]) for c in (key, text))
    held = docs.toDF(*names).withColumn("_own", F.coalesce(at.cast("long"), F.lit(-(1 << 63)))).withColumn("_content", F.xxhash64(F.coalesce(said, F.lit(""))))
    known = (F.col("_own") == F.col("_k")) & (F.col("_content") == F.col("_h"))
    kept = held.join(_few(chosen), known).drop("_k", "_h")
    # rows that are equal in key and text: mostly there are none, and then no text is shuffled
    again = stored(rows.groupBy(F.col("k").alias("_k"), F.col("h").alias("_h")).count().filter("count > 1").select("_k", "_h"), "again")
    if not again.isEmpty():
        plain = [n for n, f in zip(names, docs.schema.fields, strict=True) if isinstance(f.dataType, AtomicType)]
        several = kept.join(_few(again), known).drop("_k", "_h")
        one = several.groupBy("_own", "_content").agg(F.min_by(F.struct(*names), F.xxhash64(*plain)).alias("_row")).select("_row.*")
        kept = kept.join(_few(again), known, "left_anti").select(*names).unionByName(one)
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
