"""SimHash groups and repeated passages against brute force."""

import hashlib
import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.conftest import SF

from tallyframe.llm import queries, simhash, suffixes
from tallyframe.llm.components import connected


def fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius):
    ids, left, out = sorted(fps), set(fps), {}
    for i in ids:
        if i not in left:
            continue
        todo, left = [i], left - {i}
        while todo:
            x = todo.pop()
            out[x] = i
            near = [y for y in left if (fps[x] ^ fps[y]).bit_count() <= radius]
            left.difference_update(near)
            todo += near
    return out


def test_near_query(spark):
    fps = {r.doc_id: fingerprint(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = groups(fps, 4)
    got = queries.op2_simhash_near_dedup(spark, SF).collect()
    assert len(got) == len(fps)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])


@pytest.mark.parametrize(("size", "cuts"), [(8192, 1), (16, 2), (16, 4)])
def test_links_of_dense_points(spark, monkeypatch, size, cuts):
    monkeypatch.setattr(simhash, "SLICE", size)
    rng = random.Random(5)
    fps = {}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 20])):
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            fps[len(fps)] = x
    want = groups(fps, 4)
    points = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "i long, fp long")
    roots = {r.node: r.root for r in connected(simhash.links(points.select("fp").distinct(), 4, cuts)).collect()}
    got = defaultdict(set)
    for r in points.collect():
        got[roots.get(r.fp, r.fp)].add(r.i)
    expect = defaultdict(set)
    for i, c in want.items():
        expect[c].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expect.values()))


@pytest.mark.parametrize("groups", [1, 2, 4])
def test_points_within_the_radius_meet_in_a_cell(spark, groups):
    rng = random.Random(groups)
    rows = []
    for i in range(200):
        a = rng.getrandbits(64)
        b = a
        for j in rng.sample(range(64), 4):
            b ^= 1 << j
        rows += [(i, x - (1 << 64) if x >> 63 else x) for x in (a, b)]
    cells = defaultdict(set)
    for r in simhash.cells_entered(spark.createDataFrame(rows, "i long, fp long").select("fp"), groups, 4).collect():
        cells[r.fp].add((r.table, r.cell))
    assert all(cells[a] & cells[b] for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True))
    assert simhash.groups_for(10**6, 4) == 2


def test_wide_fingerprints_find_close_texts(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, close, far = [], [], []
    for i in range(60):
        text = [word() for _ in range(300)]
        near, other = list(text), list(text)
        for j in rng.sample(range(300), 4):  # about 20 of 296 shingles differ
            near[j] = word()
        for j in rng.sample(range(300), 60):
            other[j] = word()
        rows += [(10 * i, " ".join(text)), (10 * i + 1, " ".join(near)), (10 * i + 2, " ".join(other))]
        close.append(10 * i + 1)
        far += [10 * i, 10 * i + 2]
    rows.append((0, rows[0][1]))
    kept = [r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == len(set(kept)) and set(far) <= set(kept)
    assert len(set(close) & set(kept)) <= 2


def test_near_edges(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 10
    zero = [r for r in rows if r.doc_id in (2, 3, 7)]
    assert all(r.fingerprint == "0" * 16 and r.component_id == 2 for r in zero)
    assert {r.component_id for r in rows if r.doc_id in (1, 4)} == {1}
    assert simhash.near_duplicates(no_docs).count() == 0
    left = simhash.deduplicate(odd_docs).collect()
    assert {r.doc_id for r in left} == {None, 1, 2, 5, 6, 8} and left[0].asDict().keys() == set(odd_docs.columns)
    assert simhash.deduplicate(no_docs).count() == 0


def brute(texts, size):
    starts = defaultdict(int)
    for t in texts:
        for i in range(len(t) - size + 1):
            starts[hashlib.md5(t[i : i + size]).digest()] += 1
    out = []
    for t in texts:
        inside = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - size + 1):
            if starts[hashlib.md5(t[i : i + size]).digest()] > 1:
                inside[i + 1 : i + 1 + size] = True
        kept = bytes(b for b, x in zip(t, inside[1:]) if not x)
        out.append((len(t), len(t) - len(kept), int((inside[1:] & ~inside[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def same(spark, texts, size):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicate(docs, size).collect()}
    want = brute([(t or "").encode() for t in texts], size)
    assert [got[i] for i in range(len(texts))] == want
    return want


def test_passages_of_the_table(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = same(spark, texts, 400)
    assert any(w[1] for w in want)


@pytest.mark.parametrize("seed", range(3))
def test_passages_of_odd_texts(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    pool = [" ".join(word() for _ in range(rng.randint(20, 300))) for _ in range(12)]
    texts = [None, "", "a" * 399, "b" * 400, "c" * 900, "ab" * 700, "xyz " * 300, "x" * 1200, pool[0], pool[0]]
    for _ in range(40):
        a, b = rng.choice(pool), rng.choice(pool)
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        texts.append(word() + a[i : i + rng.randint(300, 900)] + word() + b[j : j + rng.randint(390, 480)] + word())
        t = list(rng.choice(texts[10:]))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = "Z"
        texts.append("".join(t))
    same(spark, texts, 400)


def test_passage_edges(spark, odd_docs, no_docs):
    rows = suffixes.deduplicate(odd_docs, keep=True).collect()
    assert len(rows) == 10 and {"kept", "lang", "part"} <= set(rows[0].asDict())
    assert suffixes.deduplicate(no_docs).count() == 0


def jaccard_groups(rows, k=5, similarity=0.8):
    """Sets of row numbers connected by links of that Jaccard similarity over all pairs."""
    sets = [set(simhash.shingle_hashes(simhash.words_of(t), k)) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (not sets[i] and not sets[j]) or (len(both := sets[i] & sets[j]) and len(both) / len(sets[i] | sets[j]) >= similarity):
                label = [label[j] if x == label[i] else x for x in label]
    return [{i for i, x in enumerate(label) if x == c} for c in set(label)]


def test_similarity_of_shingle_sets_decides(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for size in [12, 60, 300] * 12:
        text = [word() for _ in range(size)]
        rows.append((len(rows), " ".join(text)))
        for share in (0.015, 0.02, 0.025, 0.03):  # similarities around 0.8
            near = list(text)
            for j in rng.sample(range(size), max(1, round(share * size))):
                near[j] = word()
            rows.append((len(rows), " ".join(near)))
        rows.append((len(rows), " ".join([*text, *[word() for _ in range(size // 5)]])))  # one set in the other
    for _ in range(8):  # a repeated line rules both of two unrelated texts
        line = " ".join(word() for _ in range(7)) + "\n"
        rows += [(len(rows) + i, line * 14 + " ".join(word() for _ in range(102))) for i in range(2)]
    want = {min(g) for g in jaccard_groups(rows)}
    assert 40 < len(want) < len(rows) - 40
    got = [r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(want)


def test_rows_of_null_and_equal_keys(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(str(rng.random()) for _ in range(60)) for _ in range(4))
    rows = [(None, a), (5, a), (None, b), (7, b), (9, c), (9, d), (9, d), (10, c)]
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, a), (0, b), (9, c), (9, d)])


def test_passages_of_over_fifty_words(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    own = lambda: " ".join(word(12) for _ in range(70))
    short, long, less = (" ".join(word(n) for _ in range(m)) for n, m in ((2, 51), (6, 200), (9, 50)))
    texts = [None, "", "x", own(), " ".join(["ab"] * 60), "中文" + "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(80)), own() * 1]
    texts += [f"{own()} {p} {own()}" for p in (short, long, less) for _ in range(3)]
    texts += [f"{own()}\n{long[200:900]}", short, long.replace(" ", "\n"), texts[3], f"{own()} {texts[5]} {own()}"]
    found = [suffixes.WORD.findall(t or "") for t in texts]
    places = defaultdict(int)
    for w in found:
        for i in range(len(w) - 50):
            places[tuple(w[i : i + 51])] += 1
    want = []
    for w in found:
        inside = {i + j for i in range(len(w) - 50) if places[tuple(w[i : i + 51])] > 1 for j in range(51)}
        want.append([x for i, x in enumerate(w) if i not in inside])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffixes.deduplicate_words(docs, 51).collect()}
    assert got[0] is None and [suffixes.WORD.findall(got[i] or "") for i in range(len(texts))] == want
    assert not any(want[i] for i in (3, 4, 5)) and all(less in got[i] for i in (13, 14, 15)) and all(len(want[i]) == 140 for i in (7, 8, 9))


def test_texts_without_repeats_do_not_move(spark, monkeypatch):
    """Only texts with a repeat are met by content; more of them than ``KEYS`` are met by a shuffle, with equal results."""
    rng = random.Random(4)
    other = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = other(80)
    rows = [(i, other(120) if i % 5 else f"{other(20)} {shared} {other(20)}", "s") for i in range(40)] + [(40, None, "s"), (41, "", "s"), (None, shared, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    said, real = [], suffixes.extended
    monkeypatch.setattr(suffixes, "extended", lambda df, *x, **y: said.append(df.count()) or real(df, *x, **y))
    got = [sorted(map(tuple, suffixes.deduplicate_words(docs, 51).collect()), key=str)]
    monkeypatch.setattr(suffixes, "KEYS", 0)
    got.append(sorted(map(tuple, suffixes.deduplicate_words(docs, 51).collect()), key=str))
    assert got[0] == got[1] and said == [11, 43] and len(got[0]) == 43 and not any(t and shared in t for _, t, _ in got[0])


def test_pipeline_removes_short_words_passages(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, shorter = " ".join(word(3) for _ in range(51)), " ".join(word(9) for _ in range(50))
    rows = [(i, " ".join(word(8) for _ in range(60)) + " " + p, "en", "a", 1) for i, p in enumerate([passage, passage, shorter, shorter])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: len(r.text.split()) for r in corpus_pipeline.remove_passages(spark, docs, SF).collect()}
    assert got == {0: 60, 1: 60, 2: 110, 3: 110}


def family(n, common=170, own=30):
    """Texts that share a long passage, each with words of its own: five-word shingle similarity about 0.71."""
    passage = " ".join(f"c{i}" for i in range(common))
    return [(k, passage + " " + " ".join(f"o{k}x{i}" for i in range(own))) for k in range(n)]


def test_like_texts_do_not_meet_in_pairs(spark, monkeypatch):
    """A family of like texts that are not near enough: what is written grows with the family, not with its square."""
    sizes, kept = {}, simhash.stored

    def counted(df, name):
        out = kept(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    made = []
    for n in (60, 240):
        sizes.clear()
        assert simhash.deduplicate(spark.createDataFrame(family(n), "doc_id long, text string")).count() == n
        made.append((sizes["crossing"], sizes["pairs"], sum(v for k, v in sizes.items() if k != "dealt")))
    assert all(crossing <= 2 for crossing, _, _ in made) and made[1][1] <= 2 * 240 and made[1][2] < 5 * made[0][2]


def test_parities_rule_out_like_texts(spark, monkeypatch):
    """Texts of similarity 0.73 share rare shingles early enough for their places; few of their pairs are written, and all links are found."""
    rng, kept, sizes = random.Random(9), simhash.stored, {}
    start = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        t = list(start)
        for at in rng.sample(range(10, 190, 5), 3):
            t[at] = f"x{i}.{at}"
        texts.append(" ".join(t))
    sets = [simhash.shingle_set(t, 5) for t in texts]
    assert all(simhash.parity(a).size == 8 and np.bitwise_count((simhash.parity(a) ^ simhash.parity(b)).view("u8")).sum() <= len(np.setxor1d(a, b)) for a in sets for b in sets[:9])
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]

    def counted(df, name):
        out = kept(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    got = simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(root)) and sizes["crossing"] <= 120


def test_prefixes_find_what_sets_have(spark):
    """Pairs of every similarity around the limit, across families that share shingles, against all pairs of sets."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(25):
        start = [rng.choice(words) for _ in range(rng.randrange(30, 160))]
        for _ in range(6):
            t = list(start)
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += [t for _, t in family(30)] + ["", "short text", "short text", "four words are here"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = sorted(r.doc_id for r in simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect())
    assert got == sorted({find(i) for i in range(len(texts))})


def test_equal_rows_leave_a_defined_one(spark):
    rows = spark.createDataFrame([(1, "same text of some words here", i, {"k": i}) for i in range(6)], "doc_id long, text string, other int, m map<string, int>")
    left = {simhash.deduplicate(rows.repartition(n)).first().other for n in (1, 2, 5)}
    assert len(left) == 1


def test_fingerprints_of_sets_meet_in_the_range_join(spark, monkeypatch):
    """The near-duplicate stage links by fingerprints and the range join before any other way, and the sets check that."""
    import random

    rng = random.Random(8)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(900)] for _ in range(6)]
    texts += [[*t[:i * 100], "other", *t[i * 100 + 1:]] for i, t in enumerate(texts[:4])] + [texts[5] * 2]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [simhash.shingle_set(" ".join(t), 5) for t in texts]
    votes = [simhash.set_vote(x) & (1 << 64) - 1 for x in sets]
    assert votes == [int(v) for v in simhash.votes([x.tolist() for x in sets])]
    want = {(a, b) for a in range(len(votes)) for b in range(a + 1, len(votes)) if (votes[a] ^ votes[b]).bit_count() <= simhash.REACH}
    assert len(want) >= 3
    points = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(votes)], "node long, vote long")
    assert {(r.a, r.b) for r in simhash.fingerprint_pairs(points).collect()} == want
    calls, real = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *x: calls.append(x) or real(*x))
    assert sorted(r.doc_id for r in simhash.deduplicate(rows).collect()) == [0, 1, 2, 3, 4, 5]
    assert len(calls) == 1


def test_hashes_of_windows_are_of_their_bytes(monkeypatch):
    """Windows are hashed for a piece of a text together, whatever its edges; equal bytes have equal hashes, others different ones."""
    rng = np.random.default_rng(11)
    raw = bytes(rng.integers(97, 99, 3000, dtype=np.uint8))
    raw += raw[500:1500] + b"a" * 900
    for size, piece in ((400, 1 << 16), (400, 37), (65, 100)):
        monkeypatch.setattr(suffixes, "PIECE", piece)
        at = np.flatnonzero(rng.random(len(raw) - size + 1) < 0.7)
        half = (size + 1) // 2
        for got, start in zip(suffixes.hashes(raw, at, size), (0, size - half), strict=True):
            strings = [raw[i + start : i + start + half] for i in at.tolist()]
            assert len(set(strings)) == len(set(got.tolist())) == len(set(zip(strings, got.tolist(), strict=True)))
    assert [len(x) for x in suffixes.hashes(raw, np.zeros(0, np.int64), 400)] == [0, 0]
