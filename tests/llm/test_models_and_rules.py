"""WARC records, language model, languages, quality rules, fingerprints and the pipeline against plain counts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import pytest
import xxhash
from tests.conftest import SF
from tests.oracle import connect, difference

from tallyframe.llm import fingerprints, language, maxent, quality, queries, warc


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def crc(key, modulus):
    return zlib.crc32(str(key).encode()) % modulus


def test_warc_query(spark):
    df = queries.op1_warc_derivatives(spark, SF)
    assert difference(df.collect(), df.columns, connect(SF), queries.ORACLES["op1_warc_derivatives"]) == ""


def test_warc_records(spark):
    pages = spark.createDataFrame([(1, "http://a", "<title>T &amp; t</title><p>x<script>no</script>  y</p>", 9), (None, None, None, 9), (1, "http://a", "", 9)], "page_id long, url string, html string, block int")
    rows = warc.derive(pages).collect()
    # ids follow key, payload and kind, so the two payloads of page 1 have ids of their own
    assert len(rows) == 6 and len({r.record_id for r in rows}) == 6 and len({r.refers_to for r in rows}) == 3
    text = next(r for r in rows if r.warc_type == "conversion" and r.block)
    assert text.block == "T & t\nx y" and text.content_length == 9
    assert text.block_digest == "sha256:" + hashlib.sha256(b"T & t\nx y").hexdigest()
    whole = [r.warc for r in warc.serialised(warc.derive(pages), "2026-01-01T00:00:00Z").collect()]
    assert all(w.startswith("WARC/1.1\r\nWARC-Type: ") and "WARC-Refers-To: <urn:uuid:" in w for w in whole)
    assert warc.derive(pages.filter("false")).count() == 0


def test_warc_decodes_every_reference(spark):
    import html

    names = [f"&{n}" for n in html.entities.html5 if n not in ("nbsp;", "nbsp", "NonBreakingSpace;")]
    numbers = ["&#233;", "&#x27;", "&#X1F600;", "&#xe9", "&#65", "&#0;", "&#128;", "&#xD800;", "&#x110000;", "&amp;lt;", "&amp;#233;", "&none;", "& b", "&", "&&amp;", "&notit;"]
    pages = spark.createDataFrame(list(enumerate(f"<p>x{r}y</p>" for r in names + numbers)), "page_id long, html string").selectExpr("page_id", "'' url", "html")
    got = {r.page_id: r.block for r in warc.derive(pages).filter("warc_type = 'conversion'").collect()}
    tidy = lambda t: re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f\x0B]+", " ", t)).strip(" \n")
    assert [got[i] for i in range(len(got))] == [tidy(html.unescape(f"x{r}y")) for r in names + numbers]
    spaces = spark.createDataFrame([(1, "", "a&nbsp;&#160;&nbsp b\xa0c &copy; 1 &middot; 2")], "page_id long, url string, html string")
    assert warc.derive(spaces).filter("warc_type = 'conversion'").first().block == "a b\xa0c © 1 · 2"


def test_language_model(spark, docs):
    got = {r.doc_id: r for r in queries.op4_maxent_scoring(spark, SF).collect()}
    seen = Counter()
    for d in docs:
        if crc(d.doc_id, 10):
            seen.update([*words(lower(d.text)), None])
    total = seen.total()
    own = base = 0.0
    for d in docs:
        r, toks = got[d.doc_id], [*words(lower(d.text)), None]
        want = sum(math.log10((seen[t] + 0.1) / (total + 0.1 * (len(seen) + 1))) for t in toks)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(d.doc_id, 10) == 0, len(toks), sum(t in seen for t in toks), total)
        assert r.base_score == pytest.approx(want, rel=1e-9) and r.score < 0
        if r.held_out:
            own, base = own + r.score, base + r.base_score
    assert own > base


def test_language_model_edges(spark, odd_docs, no_docs):
    rows = maxent.score(odd_docs).collect()
    assert len(rows) == 10 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert maxent.score(no_docs).count() == 0


def test_probabilities_sum_to_one_and_gradient_is_right():
    import numpy as np

    rng = np.random.default_rng(0)
    n = 200
    classes = np.concatenate((np.arange(2, 2 + maxent.SINGLE), rng.integers(2 + maxent.SINGLE, maxent.CLASSES, n - maxent.SINGLE)))
    share = rng.random(n)
    share /= np.bincount(classes, share, maxent.CLASSES)[classes]
    lex = maxent.Lexicon([b"w%d" % i for i in range(n)], classes, np.log10(share), np.zeros(n))
    hashed, pairs = 1 << 12, rng.normal(size=maxent.PAIRED)
    w = rng.normal(size=(hashed, maxent.CLASSES))
    norm = maxent.normalisers(lex, pairs)
    for one, two in ((-2, -2), (5, -2), (7, 60), (-1, 3)):
        history = maxent.END if one == -2 else maxent.RARE if one == -1 else classes[one]
        f = maxent.features(np.array([one]), np.array([two]), hashed)
        by_class = np.exp(maxent.log_probabilities(w, f))[0]
        inner = [10 ** maxent.word_scores(lex, pairs, norm, np.array([-2 if one == -2 else one, i]), np.array([history, classes[i]]))[1] for i in range(n)]
        total = sum(by_class[c] * p for c, p in zip(classes, inner, strict=True)) + by_class[maxent.END] + by_class[maxent.RARE]
        assert total + sum(by_class[c] for c in range(2, maxent.CLASSES) if not len(lex.members[c])) == pytest.approx(1)
    f, kind = maxent.features(rng.integers(-2, n, 50), rng.integers(-2, n, 50), hashed), rng.integers(0, maxent.CLASSES, 50)
    ids, g = maxent.gradient(w, f, kind)
    loss = lambda w: -maxent.log_probabilities(w, f)[np.arange(50), kind].sum()
    for i in range(0, len(ids), 7):
        for c in (0, 3, kind[0]):
            up, down = w.copy(), w.copy()
            up[ids[i], c] += 1e-5
            down[ids[i], c] -= 1e-5
            assert g[i, c] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-5)
    group = int(classes[-1])
    own = lex.members[group]
    n_of = rng.integers(0, 9, len(own))
    buckets, less, expected = maxent.word_gradient(pairs, lex, 5, group, own, n_of)
    p = share[own] * np.exp(pairs[buckets])
    assert np.allclose(expected, n_of.sum() * p / p.sum()) and np.allclose(less, n_of - expected)
    halves = [maxent.word_gradient(pairs, lex, 5, group, own[i::2], n_of[i::2])[1] for i in range(2)]
    assert np.allclose(sum(halves), less)


def test_languages(spark):
    rows = queries.op5_language_mixture(spark, "/root/testdata/sf0.01").collect()
    true = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out and true[r.doc_id] and r.lang_pred != "und"]
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) for r in rows) and len(rows) == len(true)
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.9 * len(held) > 0


def test_language_edges(spark, odd_docs, no_docs):
    rows = language.held_out_languages(odd_docs).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred == "und" for r in rows if r.doc_id in (2, 3, 7))
    assert language.held_out_languages(no_docs).count() == 0


def test_mixed_text(spark):
    en, de = "the quick brown fox jumps over the lazy dog and runs away ", "der schnelle braune fuchs springt ueber den faulen hund weg "
    model = language.train(spark.createDataFrame([(en * 20, "en"), (de * 20, "de")], "text string, lang string"))
    lang, share, both, like = language.identify(en * 6 + de * 3, *model)
    assert (lang, like) == ("en", True) and 0.5 < share < 0.85 and both.startswith("en:") and ",de:" in both


def base(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i, x in enumerate(zip(w, w[1:], w[2:])):
        if windows[x] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def line_key(line):
    return " ".join(words(line.lower()))


def test_quality_query(spark, docs):
    hosts, holders = {}, Counter()
    for d in docs:
        hosts.setdefault(d.source or "", {}).setdefault(d.text or "", {line_key(x) for x in (d.text or "").split("\n")} - {""})
    for h, texts in hosts.items():
        for lines in texts.values():
            holders.update((h, x) for x in lines)
    got = {r.doc_id: r for r in queries.op8_quality_lines(spark, SF).collect()}
    for d in docs:
        r, (n, chars, symbols, dup, rep), h = got[d.doc_id], base(d.text), d.source or ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        failed = n < 50 or 100 * rep > 50 * n
        bad = sum(len(words(x)) for x in (d.text or "").split("\n") if holders[h, line_key(x)] > max(5, 0.1 * len(hosts[h])))
        assert (r.base_failed, r.n_line_words) == (failed, bad)
        assert r.kept == (not failed and n - bad >= 50 and bad < 0.5 * n)


def test_quality_removes_lines(spark, odd_docs, no_docs):
    good = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, f"Cookie  notice\n{good(i)}", "en", "h", 1, 9) for i in range(30)]
    out = quality.quality(spark.createDataFrame(rows, odd_docs.schema), keep=True).collect()
    assert len(out) == 30 and all(r.kept and r.text == good(r.doc_id) and r.part == 9 for r in out)
    assert len(quality.quality(odd_docs).collect()) == 10 and quality.quality(no_docs).count() == 0


def test_fingerprint_query(spark, docs):
    def simhash(text):
        votes, total = [0] * 64, 0
        for w in text.lower().split():
            n = 1 if len(w) <= 3 else min(len(w), 16)
            h, total = xxhash.xxh64_intdigest(w.encode(), 42), total + n
            for b in range(64):
                votes[b] += n * (h >> b & 1)
        return sum(1 << b for b in range(64) if 2 * votes[b] > total)

    got = {r.doc_id: r for r in queries.op9_document_fingerprints(spark, SF).collect()}
    texts = [d.text or "" for d in docs]
    fps = [simhash(t) for t in texts]
    classes = set(fps)
    for i, d in enumerate(docs):
        r, t, following = got[d.doc_id], texts[i], (i + 1) % len(docs)
        quarter = len(t) // 4
        edited = t[: len(t) - quarter] + texts[following][:quarter]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (f"{fps[i]:016x}", f"{simhash(edited):016x}")
        assert r.near_edited == 1 - (fps[i] ^ simhash(edited)).bit_count() / 64
        assert r.near_next == 1 - (fps[i] ^ fps[following]).bit_count() / 64
        assert r.n_links == sum(0 < (fps[i] ^ f).bit_count() <= 3 for f in classes)


def test_fingerprint_edges(spark, odd_docs, no_docs):
    assert fingerprints.edited_fingerprints(odd_docs).count() == 10
    assert fingerprints.edited_fingerprints(no_docs).count() == 0


def test_pipeline(spark, docs):
    """Each stage keeps what its rule keeps, and the last packs exactly the tokens of what the others left."""
    at, sizes = spark.read.parquet(f"{SF}/documents.parquet"), {}
    stages = [(n, f) for n, f in corpus_pipeline.STAGES]
    assert [n for n, _ in stages] == ["language_mixture", "quality_lines", "simhash_near_dedup", "suffix_array_dedup", "mixture_packing"]
    before = {d.doc_id: d.text for d in docs}
    for name, stage in stages[:-1]:
        at = spark.createDataFrame(rows := stage(spark, at, SF).collect(), at.schema)
        assert at.columns == corpus_pipeline.COLUMNS
        now = {r.doc_id: r.text for r in rows}
        assert len(now) == len(rows) and now.keys() <= before.keys()
        if name == "language_mixture":
            assert all(re.search(r"[^\W\d_]", t) for t in now.values())
        if name == "quality_lines":
            assert all(len(words(t)) >= 50 for t in now.values())
        if name == "simhash_near_dedup":
            assert len(set(now.values())) == len(now) and all(before[k] == t for k, t in now.items())
        if name == "suffix_array_dedup":
            assert now.keys() == before.keys()
        sizes[name], before = len(rows), now
    assert sizes["simhash_near_dedup"] < sizes["quality_lines"] < sizes["language_mixture"]
    left = {r.doc_id: r for r in at.collect()}
    pieces = corpus_pipeline.pack_sequences(spark, at, SF).collect()
    assert {p.doc_id for p in pieces} == set(left)
