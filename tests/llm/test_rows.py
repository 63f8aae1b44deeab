"""Every operator over keys beyond 2**53 beside null, and over columns of clashing names."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from tallyframe.llm import bpe, fingerprints, language, maxent, packing, quality, queries, resampling, sharding, simhash, suffixes, token_index, warc

BIG = (1 << 53) + 1
RESULTS = {
    "near": lambda d: simhash.near_duplicates(d), "kept": lambda d: simhash.deduplicate(d), "pack": lambda d: packing.pack(d, queries.JSON_VOCABULARY), "score": lambda d: maxent.score(d),
    "language": lambda d: language.held_out_languages(d), "index": lambda d: token_index.token_index(d, queries.JSON_VOCABULARY), "passages": lambda d: suffixes.deduplicate(d, keep=True),
    "words": lambda d: suffixes.deduplicate_words(d, 51), "quality": lambda d: quality.quality(d, keep=True), "prints": lambda d: fingerprints.edited_fingerprints(d), "bpe": lambda d: bpe.digests(d, queries.RANK_VOCABULARY),
    "resample": lambda d: resampling.resample(d, d), "shards": lambda d: sharding.sharded(d),
}


@pytest.mark.parametrize("name", sorted(RESULTS))
def test_keys_and_names(spark, name):
    clash = ["_row", "_key", "_host", "_text", "_content", "_t", "_k", "d", "c", "k", "node", "raw"]
    rows = [(k, f"{w} " * 30 + "some words of a text", "en", "a", 1, *range(len(clash))) for k, w in ((BIG, "one"), (None, "two"), (7, "three"), (-BIG, "four"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash))
    assert {r.doc_id for r in RESULTS[name](docs).select("doc_id").collect()} == {BIG, None, 7, -BIG}


def test_lookup_reads_shards_by_key(spark, no_docs):
    from tallyframe.llm.common import scratch

    path = scratch(spark, "shards")
    docs = spark.createDataFrame([(i * 10, f"text {i}") for i in range(200)] + [(500, "again"), (None, "none")], "doc_id long, text string")
    token_index.write_shards(docs, path, queries.JSON_VOCABULARY, shard_ids=40)
    known = token_index.Directory.of(spark, path)
    assert len(known.paths) > 4 and (np.diff(known.base) > 0).all()
    asked = spark.createDataFrame([(k,) for k in (0, 500, 1990, 5, -1, 10**12, None, 0)], "doc_id long")
    got = sorted(r.doc_id for r in token_index.lookup(asked, path).collect())
    assert got == [0, 500, 500, 1990]
    assert token_index.lookup(asked.filter("doc_id = 5"), path).count() == 0
    assert [r.doc_id for r in token_index.lookup(asked.filter("doc_id = 5"), path, nulls=True).collect()] == [None]


def test_quality_words_and_letters():
    assert quality.describe("\x1c\n\x1c")[3] == 1 and quality.describe("\xa0\n\x85\n\xa0")[3] == 1 and quality.describe(" \n\x0b\n")[3] == 0
    model = (["a", "b"], np.full((64, 2), 1 / 64))
    assert [language.identify(t, *model)[0] for t in ("½ ² Ⅷ ①", "12 _", "é")] == ["und", "und", "a"]


def test_quality_sql(spark):
    from tests.oracle import connect, difference

    df = queries.op8_quality_lines(spark, SF)
    assert difference(df.collect(), df.columns, connect(SF), queries.ORACLES["op8_quality_lines"]) == ""


@pytest.mark.parametrize(("docs", "holders", "bad"), [(10, 6, True), (10, 5, False), (100, 11, True), (100, 10, False), (900, 91, True), (900, 89, False)])
def test_boilerplate_share(spark, docs, holders, bad):
    rows = [(i, f"own line {i}\n" + ("common line" if i < holders else f"other {i}"), "h") for i in range(docs)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).agg(F.sum("n_line_words")).first()[0]
    assert got == (2 * holders if bad else 0)


def test_expectation_maximisation():
    rng = np.random.default_rng(2)
    probs = rng.dirichlet(np.ones(30), 3).T
    counts = rng.multinomial(500, probs @ [0.7, 0.3, 0.0]).astype(float)
    pi, ll = language.mixture(counts, probs[:, :2])
    grid = max((float(counts @ np.log(probs[:, :2] @ [p, 1 - p])), p) for p in np.linspace(0.001, 0.999, 999))
    assert abs(pi[0] - grid[1]) < 0.05 and ll == pytest.approx(grid[0], abs=0.5)
    # a language more can only help once EM has converged; its rounds are bounded, so a little is missing
    assert language.mixture(counts, probs)[1] >= ll - 2


def test_dense_ranks_of_a_sort(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), i % 7, i) for i, (a, b) in enumerate(zip(rng.integers(0, 40, 3000) ** 2 // 40, rng.integers(0, 9, 3000)))] + [(5, 5, 1, 10_000 + i) for i in range(2000)]
    df = spark.createDataFrame(rows, "x long, y long, d long, e long").repartition(5)
    got = {(r.d, r.e): r.r for r in suffixes.ranked(df, ["x", "y"], "test").collect()}
    names, seen = {}, {}
    for x, y, d, e in rows:
        seen.setdefault((x, y), []).append((d, e))
    for i, key in enumerate(sorted(seen)):
        names[key] = i
    assert got == {p: names[k] for k, places in seen.items() if len(places) > 1 for p in places}


def test_warc_ids_follow_the_payload(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>b")], "page_id long, url string, html string")
    rows = warc.derive(pages).collect()
    assert len({r.record_id for r in rows}) == 4 and len({r.refers_to for r in rows}) == 2
    text = warc.serialised(warc.derive(pages), "2026-01-01T00:00:00Z").first().warc
    assert "X-Source-Content-Type: text/html\r\n" in text and "X-Source-Payload-Digest: sha256:" in text


def test_stage_names_and_packed_tokens(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * (i + 1), "en", "a", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    pieces = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    assert {p.doc_id: p.doc_tokens for p in pieces} == {d: sum(p.length for p in pieces if p.doc_id == d) for d in range(20)}
