"""Packing, token index and byte-level BPE against the libraries and plain counts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tests.conftest import SF
from tokenizers import Tokenizer

from tallyframe.llm import bpe, packing, queries, token_index
from tallyframe.llm.common import scratch
from tallyframe.llm.encoders import library_encoder, merge, rank_encoder
from tallyframe.llm.pretokens import boundaries

JSON, RANKS = queries.JSON_VOCABULARY, queries.RANK_VOCABULARY


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda s, end: np.array(t.encode(s, add_special_tokens=False).ids + [end], "<u4").tobytes()


@pytest.fixture(scope="module")
def tik():
    e = rank_encoder(RANKS)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.ranks, special_tokens={})


def odd_texts(n=3000):
    rng, letters = random.Random(3), [*"abz'strevlmd' \n\t  123!?é ́\x1c中\0\x85", "the", "ing", "\r\n", "🙂", "　"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", "a" * 500, "ab" * 400, " " * 300 + "x", "<|endoftext|> x"]


def test_boundaries_are_the_patterns(tik):
    pattern, texts = regex.compile(P.PATTERN), odd_texts()
    for s, b in zip(texts, boundaries(texts), strict=True):
        assert [s[i:j] for i, j in zip(b, b[1:])] == pattern.findall(s)


def test_encoders_equal_the_libraries(tik, library):
    texts = odd_texts()
    for s, x, y in zip(texts, rank_encoder(RANKS).encode(texts), library_encoder(JSON).encode(texts), strict=True):
        assert np.frombuffer(x, "<u4").tolist() == tik.encode_ordinary(s)
        assert y + (7).to_bytes(4, "little") == library(s, 7)


def test_long_and_short_merges_agree():
    ranks = rank_encoder(RANKS).ranks
    for s in ("ab" * 32 + "a", "thethething" * 8, "a" * 70):
        from tallyframe.llm.encoders import _merge_long

        short, long_ = merge(s.encode()[:60], ranks), _merge_long(s.encode()[:60], ranks)
        assert short == long_


def test_bpe_query(spark, tik):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op10_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tik.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_bpe_columns(spark, odd_docs, no_docs):
    out = bpe.decode(bpe.encode(odd_docs, RANKS, offsets="part"), RANKS, out="lang").collect()
    assert len(out) == 10
    for r in out:
        assert bytes(r.lang) == (r.text or "").encode() and len(r.part) == len(r.ids)
    assert bpe.digests(no_docs, RANKS).count() == 0 and bpe.digests(odd_docs, RANKS).count() == 10


def test_index_query(spark, library):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in queries.op6_token_index(spark, SF).collect()}
    at = 0
    for d in docs:
        ids = library(d.text or "", 0)
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert len(got) == len(docs)


def test_index_shards(spark, odd_docs, no_docs, library):
    rows = token_index.token_index(odd_docs, JSON, shard_ids=50).collect()
    assert len(rows) == 10 and sum(r.doc_id == 4 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert {r.start for r in rows} == set(np.cumsum([0, *[r.n_tokens for r in sorted(rows, key=lambda r: r.start)]])[:-1].tolist())
    assert token_index.token_index(no_docs, JSON).count() == 0


def test_index_lookup():
    keys = [None, None, *sorted(random.Random(1).sample(range(10**9), 5000)), 10**9, 10**9]
    shard = token_index.Shard(token_index.pack_shard(keys, [np.array([i, 70000], "<u4").tobytes() for i in range(len(keys))]))
    first, count = shard.rows_of(np.array(keys[2:], np.int64))
    assert first.tolist() == [*range(2, 5002), 5002, 5002] and count.tolist() == [1] * 5000 + [2, 2]
    assert shard.row(7).tolist() == [7, 70000]
    foreign, _ = shard.rows_of(np.arange(2 * 10**9, 2 * 10**9 + 5000))
    assert (foreign == -1).all()


def whole(rows, window):
    """Every document in pieces without gaps, every sequence without gaps; returns tokens by sequence and source."""
    docs, seqs, mix = {}, {}, {}
    for r in rows:
        docs.setdefault((r.doc_id, r.doc_tokens, r.source), []).append((r.start, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        mix.setdefault(r.sequence_id, {}).setdefault(r.source, 0)
        mix[r.sequence_id][r.source] += r.length
    for s, pieces in seqs.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
        assert at == window or s == max(seqs)
    return docs, mix


def test_packing_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), JSON).collect()
    docs, mix = whole(rows, 2048)
    assert {d for d, _, _ in docs} == set(texts)
    for (d, n, _), pieces in docs.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == n
    for r in rows:
        ids = library(texts[r.doc_id] or "", 1)
        assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
    total = {}
    for m in mix.values():
        for s, n in m.items():
            total[s] = total.get(s, 0) + n
    share, last = sum(total.values()), max(mix)
    assert all(abs(m.get(s, 0) - 2048 * n / share) < 2 for k, m in mix.items() if k != last for s, n in total.items())


def test_packing_targets_and_edges(spark, odd_docs, no_docs):
    for shares, window in ((None, 64), ({"a": 0.75, "b": 0.25}, 16), ({"c": 1.0}, 7)):
        rows = packing.pack(odd_docs, JSON, window=window, shares=shares).collect()
        docs, mix = whole(rows, window)
        assert sum(sum(n for _, n in p) for p in docs.values()) == sum(r.length for r in rows)
        assert sum(sum(m.values()) for m in mix.values()) == sum(k[1] * (2 if k[0] == 4 else 1) for k in docs)
        if shares and "a" in shares:
            assert mix[0]["a"] == 12 and mix[0]["b"] == 4
    assert packing.pack(no_docs, JSON).count() == 0


def test_scratch_is_shared(spark):
    assert scratch(spark, "x") != scratch(spark, "x")
