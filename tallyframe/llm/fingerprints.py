"""Document fingerprints: SimHash with built-in functions only, and block tables to search them.

Every word votes with its hash: a set bit of the hash votes for that bit of the fingerprint, a
clear bit against it, with a weight by the word's length (long words tell more than short ones)
for each time it occurs. Two bits share one 64-bit sum, so 32 sums hold all votes.

Search: the 64 bits form five blocks. Fingerprints within three bits agree on two blocks at
least, so each of ten tables, keyed by two blocks brought to the front, finds the pairs that
agree there; all within the radius are found and verified.
"""

from __future__ import annotations

import json
import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import stored

RADIUS, BLOCKS = 3, 5
#: Fingerprints of one cell of a table that are compared as one list.
CHUNK = 256
#: Bytes of text in a range of keys in which successors are found.
RANGE_BYTES = 32 << 20
#: Ranges at most: their bounds pass through the driver and stand in the plan. Larger ranges are sorted with the disk's help.
MOST_RANGES = 1 << 14
#: Weight of a word by its characters: short ones count once.
SHORT, MOST = 3, 16
_SPACE = r"[\x20\x09-\x0D]+"


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def fingerprint(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``fp`` for every group of rows with equal keys: votes of all words of ``text``; without words zero."""
    word = F.explode_outer(F.split(F.lower(F.col(text)), _SPACE)).alias("_w")
    size = F.length("_w")
    weight = F.when(F.coalesce(size, F.lit(0)) == 0, 0).when(size <= SHORT, 1).otherwise(F.least(size, F.lit(MOST))).cast("long")
    votes = rows.select(*keys, word).select(*keys, F.xxhash64("_w").alias("_h"), weight.alias("_n"))
    both = _long((1 << 32) + 1)
    sums = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(both) * F.col("_n")).alias(f"_s{i}") for i in range(32)]
    summed = votes.groupBy(*keys).agg(F.sum("_n").alias("_all"), *sums)
    bits = _long(0)
    for i in range(32):
        low, high = F.col(f"_s{i}").bitwiseAND(_long((1 << 32) - 1)), F.shiftrightunsigned(f"_s{i}", 32)
        bits = bits.bitwiseOR(F.when(low * 2 > F.col("_all"), _long(1 << i)).otherwise(_long(0))).bitwiseOR(F.when(high * 2 > F.col("_all"), _long(1 << i + 32)).otherwise(_long(0)))
    return summed.select(*keys, bits.alias("fp"))


def with_next(rows: DataFrame, key: str, order: list[str], value: str, out: str, ranges: int = 0) -> DataFrame:
    """All columns, ``out`` (``value`` of the row that follows by ``key``, nulls first, then ``order``; after the last the first), _range, _nth.

    Keys are dealt to ranges of about equal rows, one for each RANGE_BYTES of ``value`` and as many as four
    times the partitions of a shuffle at least, MOST_RANGES at most; the driver gathers one bound and one least key of each.
    A range's first row also goes to the end of the range before it, where it serves as successor
    only, so each row is shuffled once and no range sees another. Rows of one key share a range.
    """
    spark = rows.sparkSession
    least = -(1 << 63)
    keyed = rows.withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit(least)))
    if not ranges:
        size = keyed.agg(F.sum(F.octet_length(F.col(value).cast("string")).cast("long"))).first()[0] or 0
        ranges = min(MOST_RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES))
    cuts = keyed.agg(F.percentile_approx("_key", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges)).first()[0] or []
    bounds = sorted(set(cuts))
    dealt = keyed.withColumn("_range", _bounds_below(F.col("_key"), bounds))
    firsts = sorted((r["_range"], r["first"]) for r in dealt.groupBy("_range").agg(F.min("_key").alias("first")).collect())
    if not firsts:
        return dealt.withColumn(out, F.col(value)).withColumn("_nth", F.lit(0)).drop("_key")
    # one row a range: its least key, and the range before it
    before = spark.createDataFrame([(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)], "_first long, _back int")
    known = dealt.join(F.broadcast(before), F.col("_key") == F.col("_first"), "left")
    places = F.array_compact(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("ghost")), F.when(F.col("_back").isNotNull(), F.struct(F.col("_back").alias("r"), F.lit(1).alias("ghost")))))
    spread = known.withColumn("_p", F.explode(places)).withColumn("_range", F.col("_p.r")).withColumn("_ghost", F.col("_p.ghost")).drop("_p", "_first", "_back")
    w = Window.partitionBy("_range").orderBy("_ghost", "_key", *order)
    led = spread.withColumn(out, F.lead(value).over(w)).withColumn("_nth", F.row_number().over(w))
    return led.filter("_ghost = 0").drop("_ghost", "_key")


def _bounds_below(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are below the key: first among every so many of them, then among those between."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    table = F.from_json(F.lit(json.dumps(parts)), "array<array<bigint>>")
    ends = F.from_json(F.lit(json.dumps([p[-1] for p in parts])), "array<bigint>")
    part = F.size(F.filter(ends, lambda b: b < key))
    return (part * step + F.size(F.filter(F.coalesce(F.get(table, part), F.array().cast("array<bigint>")), lambda b: b < key)) - F.when(part == len(parts), step * len(parts) - len(bounds)).otherwise(0)).cast("int")


def linked(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, n_links: how many other fingerprints of ``points.fp`` (distinct) lie within ``radius`` bits, where any do."""
    edges = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [((1 << b - a) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = F.array(*[_long(sum(c)) for c in combinations(blocks, BLOCKS - radius)])
    cells = points.select("fp", F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col("fp")))).alias("table", "cell"))
    several = stored(cells.groupBy(F.col("table").alias("s_table"), F.col("cell").alias("s_cell")).count().filter("count > 1"), "cells")
    held = stored(cells.join(several, (F.col("table") == F.col("s_table")) & (F.col("cell") == F.col("s_cell"))).select("fp", "table", "cell", F.pmod(F.xxhash64("fp"), F.ceil(F.col("count") / CHUNK)).alias("part")), "cells")
    lists = held.groupBy(F.col("table").alias("l_table"), F.col("cell").alias("l_cell"), "part").agg(F.collect_list("fp").alias("others"))
    met = held.drop("part").join(lists, (F.col("table") == F.col("l_table")) & (F.col("cell") == F.col("l_cell")))

    def close(x: Column) -> Column:
        differ = x.bitwiseXOR(F.col("fp"))
        # a pair counts in the first table that it agrees in
        earlier = F.exists(F.slice(masks, F.lit(1), F.col("table")), lambda m: differ.bitwiseAND(m) == 0)
        return (F.bit_count(differ) <= radius) & (differ != 0) & ~earlier

    return met.select("fp", F.size(F.filter("others", close)).alias("n")).groupBy("fp").agg(F.sum("n").alias("n_links")).filter("n_links > 0")


def edited_fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id, n_links.

    The edited text has its last quarter replaced by the start of the next document's. Likeness
    is the share of equal bits. ``class_id``: the least doc_id with the same fingerprint;
    ``n_links``: other fingerprints within ``radius`` bits. Null texts are empty (fingerprint
    zero), null ids come first, rows with equal ids follow each other by text, other columns
    are ignored and an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(rows, "doc_id", ["text"], "text", "next")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next"), F.lit(1), quarter))
    texts = led.select("_range", "_nth", "doc_id", n.cast("long").alias("n_chars"), F.col("text"), edited.alias("edited"))
    kinds = texts.select("_range", "_nth", "doc_id", "n_chars", F.sha2("edited", 256).alias("sha"), F.posexplode(F.array("text", "edited")).alias("kind", "t"))
    prints = fingerprint(kinds, ["_range", "_nth", "doc_id", "n_chars", "sha", "kind"], "t")
    pair = prints.groupBy("_range", "_nth", "doc_id", "n_chars", "sha").agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("efp"))
    pair = stored(pair.withColumnRenamed("_range", "r0").withColumnRenamed("_nth", "n0"), "prints")
    follow = with_next(pair, "doc_id", ["r0", "n0"], "fp", "next_fp")
    classes = pair.groupBy("fp").agg(F.min("doc_id").alias("class_id"))
    links = linked(classes.select("fp"), radius)
    named = stored(classes.join(links, "fp", "left").select(F.col("fp").alias("c_fp"), "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "classes")
    like = lambda a, b: 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64.0
    hex_ = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return follow.join(named, F.col("fp") == F.col("c_fp")).select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), hex_("fp").alias("fingerprint"), hex_("efp").alias("edited_fingerprint"),
        like("fp", "efp").alias("near_edited"), like("fp", "next_fp").alias("near_next"), "class_id", "n_links",
    )
