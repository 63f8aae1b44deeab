"""Scores follow from the texts alone; words of every frequency are contexts; copies of one text are dealt by key."""

import numpy as np
import pytest
from tests.conftest import SF

from tallyframe.llm import maxent


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(maxent, "SHARD", 5000)  # several shards a round
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = ({r.doc_id: r for r in maxent.score(docs.repartition(n)).collect()} for n in (2, 16))
    assert a.keys() == b.keys()
    assert max(abs(a[k].score / b[k].score - 1) for k in a) < 1e-9 and max(abs(a[k].base_score / b[k].base_score - 1) for k in a) < 1e-12
    held = [(r.score, r.base_score) for r in a.values() if r.held_out]
    assert sum(s for s, _ in held) > 0.97 * sum(x for _, x in held)


def test_rare_words_are_contexts():
    """A word without a number has features of its own, and the joint feature is that of the pair."""
    one = np.array([-3 - 7, -3 - 8, -3 - 7, 5])
    two = np.array([4, 4, -2, 4])
    f = maxent.features(one, two, 1 << 17)
    assert f.shape == (4, 3) and f[0, 0] == f[2, 0] != f[1, 0] and f[0, 1] == f[1, 1] == f[3, 1] and len(set(f[:, 2])) == 4


def test_flattened_texts():
    import pyarrow as pa

    ids = pa.array([[1, 2], [], [3]], pa.list_(pa.int32()))
    flat, sizes = maxent.flattened(ids.slice(1))
    assert flat.tolist() == [-2, 3, -2] and sizes.tolist() == [1, 2]
    flat, sizes = maxent.flattened(ids)
    assert flat.tolist() == [1, 2, -2, -2, 3, -2]
    one, two = maxent.before(flat)
    assert one.tolist() == [-2, 1, 2, -2, -2, 3] and two.tolist() == [-2, -2, 1, -2, -2, -2]


def test_vocabulary_of_one_word_and_copies(spark):
    docs = spark.createDataFrame([(i, "same text over and over") for i in range(200)] + [(1000 + i, f"own{i} text of {i}") for i in range(50)], "doc_id long, text string")
    few, many = ({r.doc_id: r for r in maxent.score(docs, vocabulary=v).collect()} for v in (1, 300_000))
    assert all(np.isfinite(r.score) for r in few.values()) and few[3].n_known == many[3].n_known and few[3].base_score == pytest.approx(many[3].base_score, rel=1e-12)
    assert many[3].score > many[3].base_score


def test_probability_of_one_class_is_that_of_all():
    rng = np.random.default_rng(3)
    weights, prior = rng.normal(0, 2, (64, maxent.CLASSES)).astype(np.float32), rng.normal(0, 1, maxent.CLASSES).astype(np.float32)
    f, kind = rng.integers(0, 64, (500, 3)), rng.integers(0, maxent.CLASSES, 500)
    for bias in (prior, None):
        want = maxent.log_probabilities(weights, f, bias)[np.arange(500), kind]
        assert (maxent.log_probability_of(weights, f, kind, bias) == want).all()


def test_numbers_of_words_are_those_of_plain_python(spark, monkeypatch):
    """Texts are split, counted and numbered as columns: the same words, whatever white space; numbers travel as bytes."""
    import zlib
    from collections import Counter

    texts = ["  The\x0bcat\tTHE \x1c x y ", "", " \n", "É cat é dog dog\r\nrare", "one", "dog  cat the rare rare"] * 3
    monkeypatch.setattr(maxent, "FLUSH", 2)
    words = [t.encode().lower().split() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").selectExpr("k", "false AS held_out", "k AS h", "t").repartition(3)
    counted = {bytes(r.w): r.n for r in maxent.word_counts(df.select("t")).collect()}
    assert counted == Counter(w for t in words for w in t) | {b"": len(texts)}
    known = [b"the", b"cat", b"dog"]
    coded = maxent.encoded(df, known)
    assert dict(coded.dtypes)["ids"] == "binary"
    for r in coded.collect():
        own = words[r.k]
        assert np.frombuffer(r.ids, np.int32).tolist() == [known.index(w) if w in known else maxent.RARE_CODE - (zlib.crc32(w) & 0x3FFFFFFF) for w in own]
        assert dict(zip(map(bytes, r.missing), r.times, strict=True)) == Counter(w for w in own if w not in known)


def test_steps_work_in_the_room_they_are_given():
    rng = np.random.default_rng(5)
    weights, prior = rng.normal(0, 1, (64, maxent.CLASSES)).astype(np.float32), rng.normal(0, 1, maxent.CLASSES).astype(np.float32)
    room = maxent.Room(600)
    for n in (600, 7):  # buckets that occur some 30 times, and once
        f, kind = rng.integers(0, 60, (n, 3)), rng.integers(0, maxent.CLASSES, n)
        ids, g, counts, own = maxent.counted_gradient(weights, f, kind, prior, room)
        p = np.exp(maxent.log_probabilities(weights, f, prior).astype(float))
        p[np.arange(n), kind] -= 1
        want = np.zeros((64, maxent.CLASSES))
        np.add.at(want, f.ravel(), np.repeat(p, 3, axis=0))
        assert ids.tolist() == sorted(set(f.ravel().tolist())) and counts.tolist() == np.bincount(f.ravel(), minlength=64)[ids].tolist()
        assert np.abs(g - want[ids]).max() < 1e-4 and (own == weights[ids]).all() and np.shares_memory(g, room.sums)
