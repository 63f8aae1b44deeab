"""Filter audit, importance resampling and sharding against plain Python and DuckDB."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.conftest import SF
from tests.oracle import connect, difference

from tallyframe.llm import audit, queries, resampling, sharding

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_importance_resampling"])
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert difference(df.collect(), df.columns, connect(SF), queries.ORACLES[name]) == ""


# filter audit


def brute_audit(rows, labels):
    """By the definition: every order applied to every document."""
    told = defaultdict(lambda: [False, False])
    for k, q, x in labels:
        told[k][0] |= q == 1
        told[k][1] |= x == 1
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    docs = []
    for k, t, p in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": k is not None and least[t] < k}
        docs.append((p or "", fails, *(told[k] if k is not None else (False, False))))
    out, shapley = {}, Counter()
    for order in itertools.permutations("ABCDE"):
        for step, f in enumerate(order):
            for part in {d[0] for d in docs}:
                mine = [d for d in docs if d[0] == part]
                gone = lambda d: any(d[1][g] for g in order[:step])  # noqa: E731, B023
                removed = [d for d in mine if d[1][f] and not gone(d)]
                shapley[part, f] += len(removed)
                unique = sum(d[1][f] and sum(d[1].values()) == 1 for d in mine)
                out[part, "".join(order), step + 1] = [sum(not d[1][f] and not gone(d) for d in mine), len(removed), sum(d[1][f] and gone(d) for d in mine), unique, sum(d[2] for d in removed), sum(d[3] for d in removed)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def audit_rows():
    rng = random.Random(4)
    long_ = " ".join(f"w{i}" for i in range(150))
    texts = [long_, long_.upper(), long_ + " #", "same " * 120, "short", "", None, "É" * 90 + " x", long_ * 40 + " tail one", long_ * 40 + " tail two", "A" * 70 + "b" * 30, " \n "]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice(["en", "de", None])) for _ in range(160)]
    labels = [(i % 25, i % 2, i % 3 == 0) for i in range(30)] + [(None, 1, 1), (3, None, None)]
    return rows, [(k, q, None if x is None else int(x)) for k, q, x in labels]


@pytest.mark.parametrize("collide", [False, True])
def test_audit_brute_force(spark, monkeypatch, collide):
    if collide:  # all texts of one length in one class: only the full comparison parts them
        monkeypatch.setattr(audit, "block_hashes", lambda text: [F.lit(1).cast("long")] * (len(audit.BLOCKS) + 1))
        monkeypatch.setattr(audit, "SHARE_ROWS", 3)
        monkeypatch.setattr(audit, "FEW_CLASSES", 0)
    rows, labels = audit_rows()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, mask int, n int").repartition(3)
    assert audited(audit.audit(docs, spark.createDataFrame(labels, LABELS))) == brute_audit(rows, labels)


def test_audit_large_class_and_empty(spark, no_docs, odd_docs):
    docs = spark.range(4000).selectExpr("id doc_id", "if(id % 3 = 0, repeat('copy ', 200), concat('own ', id)) text", "'en' lang")
    counts = {r["mask"]: r.n for r in audit.mask_counts(docs, spark.createDataFrame([], LABELS)).collect()}
    assert sum(n for m, n in counts.items() if m & audit.DUPLICATE) == len(range(0, 4000, 3)) - 1 and sum(counts.values()) == 4000
    assert audit.audit(no_docs, spark.createDataFrame([], LABELS)).count() == 0
    assert audit.audit(odd_docs, spark.createDataFrame([], LABELS)).count() == 600 * 4


def test_refinement_splits_by_blocks(spark):
    """Texts that differ in one byte of any block only do not share a class."""
    base = "x" * 400_000
    texts = [base] * 2 + [base[:at] + "y" + base[at + 1 :] for at in (0, 63, 64, 400, 1500, 6000, 20_000, 100_000, 399_999)]
    rows = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string")
    blocks = rows.select("_id", F.length("_text").alias("_length"), F.array(*audit.block_hashes(F.col("_text"))).alias("_blocks"))
    assert [(r.n, r.rep) for r in audit.refined(blocks).collect()] == [(2, 0)]


# importance resampling


def brute_resample(rows, target, longest=1, share=10, buckets=10_000, least=20):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def feats(t):
        ws = words(t)
        return [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]

    s, t = Counter(f for _, x in rows for f in feats(x)), Counter(f for x in target for f in feats(x))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (ns + buckets) / ((s[b] + 1.0) * (nt + buckets))))
    out = []
    for k, x in rows:
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, feats(x)))
        out.append([k, len(feats(x)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    can = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for i, r in enumerate(can[: share * len(can) // 100]):
        r[4] = i + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize(("longest", "share"), [(1, 10), (2, 50)])
def test_resample_brute_force(spark, longest, share):
    rng = random.Random(7)
    some = lambda n: " ".join(rng.choice(["Alpha", "béta", "γ", "d9", "the", "of", "x_y", "\x1f"]) for _ in range(n))
    rows = [(i, some(rng.randrange(60))) for i in range(300)] + [(None, some(30)), (None, None), (5, ""), (9, " ... "), (11, some(20_000))] + [(77, "same words " * 15)] * 40
    target = [some(50) + " rare", None, ""]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, k int, weight int").repartition(5)
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, share=share)
    assert Counter(map(tuple, got.collect())) == brute_resample(rows, target, longest, share)


def test_resample_edges(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(no_docs, none).count() == 0
    rows = resampling.resample(odd_docs, none).collect()
    assert len(rows) == odd_docs.count() and all(r.weight == 0 for r in rows if r.doc_id in (2, 3, 7))
    same = [Counter(map(tuple, resampling.resample(odd_docs.repartition(n), odd_docs.limit(3), share=60).collect())) for n in (1, 7)]
    assert same[0] == same[1]


def test_matrix_blocks(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 3)
    docs = spark.createDataFrame([(i, "a b a" if i % 2 else "") for i in range(10)], "doc_id long, text string").coalesce(1)
    matrix = resampling.blocks(docs, "doc_id", "text", 50, 1).collect()
    assert [len(m["keys"]) for m in matrix] == [3, 3, 3, 1] and all(len(m.starts) == len(m["keys"]) + 1 and m.starts[-1] == len(m.buckets) == len(m.counts) for m in matrix)
    sums = resampling.column_sums(resampling.blocks(docs, "doc_id", "text", 50, 1), 50)
    assert sums[zlib.crc32(b"a") % 50] == 10 and sums.sum() == 15


# sharding


def long_hash(value: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(value, seed)


def brute_shards(rows, shards, seed, bucket_bytes):
    """Both passes in plain Python; rows are distinct."""
    size = sum(len((t or "").encode()) + 8 for _, t in rows)
    buckets = max(1, -(-size // bucket_bytes))
    dealt = defaultdict(list)
    for k, t in rows:
        h = long_hash(seed.to_bytes(8, "little"), 42)
        for value in (None if k is None else str(k), t):
            h = h if value is None else long_hash(value.encode(), h)
        h = h - (1 << 64) if h >> 63 else h
        dealt[h % buckets].append((h, k, t))
    whole = []
    for b in range(buckets):
        own = [x[1:] for x in sorted(dealt[b], key=lambda x: x[0])]
        rng = np.random.Generator(np.random.PCG64([seed, b]))
        drawn = rng.integers(0, np.arange(len(own), 1, -1)) if len(own) > 1 else []
        for i, j in zip(range(len(own) - 1, 0, -1), drawn):
            own[i], own[j] = own[j], own[i]
        whole += own
    cuts = [s * len(whole) // shards for s in range(shards + 1)]
    return {(k, s, i - cuts[s]) for s in range(shards) for i, (k, _) in enumerate(whole) if cuts[s] <= i < cuts[s + 1]}


def test_sharding_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + [(None, "x"), (10**12, None), (10**12 + 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 6):
        got = sharding.sharded(docs.repartition(parts), bucket_bytes=50_000)
        assert {(r.doc_id, r.shard, r.slot) for r in got.collect()} == brute_shards(rows, 24, 13, 50_000)


def test_sharding_query(spark):
    rows = queries.op13_sharding(spark, SF).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id].encode()) + 8, zlib.crc32(docs[r.doc_id].encode()), "rows", None) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_sharding_mixes(spark):
    """Neighbours by id end up in unlike shards: every shard has about its share of the first third."""
    docs = spark.range(24_000).selectExpr("id doc_id", "concat('text ', id) text")
    held = Counter(r.shard for r in sharding.shuffled(docs, bucket_bytes=60_000).collect() if r.doc_id < 8000)
    assert all(abs(held[s] - 333) < 100 for s in range(24))


def test_sharding_edges(spark, no_docs, odd_docs):
    assert sharding.sharded(no_docs).count() == 0
    got = sharding.shuffled(odd_docs.withColumn("slot", F.lit("x")).withColumn("_h", F.lit(3))).collect()
    assert len(got) == odd_docs.count() and got[0]["_h"] == 3 and {r.slot for r in got} == {0}
    copies = spark.range(3000).selectExpr("7 doc_id", "if(id % 3 = 0, concat('t', id), 'hot row') text")
    rows = sharding.shuffled(copies, bucket_bytes=1000).collect()
    hot = Counter(r.shard for r in rows if r.text == "hot row")
    assert len(rows) == 3000 and set(Counter(r.shard for r in rows).values()) == {125} and all(n > 40 for n in hot.values()) and len(hot) == 24


def test_written_shards_hold_slots_in_order(spark, tmp_path):
    docs = spark.range(500).selectExpr("id doc_id", "repeat('t', 100) text", "id other")
    back = sharding.write_shards(docs, f"{tmp_path}/s", bucket_bytes=2000, shards=5)
    files = back.withColumn("f", F.input_file_name()).groupBy("shard", "f").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    for s in range(5):
        spans = [(r.a, r.b, r.n) for r in sorted(files, key=lambda r: r.f) if r.shard == s]
        assert spans == sorted(spans) and all(b - a + 1 == n for a, b, n in spans) and sum(n for *_, n in spans) == 100
