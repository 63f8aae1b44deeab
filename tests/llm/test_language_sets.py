"""Sets of languages against all sets, many labels, and the bound that ends the search."""

import itertools

import numpy as np
import pytest

from tallyframe.llm import language


def brute(counts, probs, penalty):
    """Best penalised likelihood over all sets, with EM run to the end."""
    best = None
    for size in range(1, probs.shape[1] + 1):
        for some in itertools.combinations(range(probs.shape[1]), size):
            p = probs[:, some]
            pi = np.full(size, 1 / size)
            for _ in range(3000 if size > 1 else 0):
                pi = pi * ((counts / (p @ pi)) @ p) / counts.sum()
            value = float(counts @ np.log(p @ pi)) - penalty * (size - 1)
            if best is None or value > best[1] + 1e-9:
                best = (some, value)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_sets_against_all_sets(seed):
    rng = np.random.default_rng(seed)
    probs = rng.dirichlet(np.full(60, 0.4), 6).T + 1e-4
    probs /= probs.sum(axis=0)
    truth = [[1, 0, 0, 0, 0, 0], [0.6, 0.4, 0, 0, 0, 0], [0.3, 0.3, 0.4, 0, 0, 0], [0.2, 0.2, 0.2, 0.2, 0.2, 0]][seed % 4]
    counts = rng.multinomial(2000, probs @ np.array(truth)).astype(float)
    held = counts > 0
    counts, probs = counts[held], probs[held]
    penalty = 3 * np.log(2000)
    some, value = brute(counts, probs, penalty)
    got, pi, best = language.chosen_set(counts, probs, penalty)
    assert sorted(got) == list(some) == [i for i, t in enumerate(truth) if t] and pi.sum() == pytest.approx(1)
    assert value - 3 < best <= value + 1e-6  # EM's rounds are bounded
    everything = language.mixture(counts, probs)
    assert language.ceiling(counts, probs, *everything) >= brute(counts, probs, 0)[1] - 1e-9


def test_many_labels(spark):
    """As many labels as texts: the same buckets, no error, and each text has its own label."""
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(40)) for _ in range(300)]
    docs = spark.createDataFrame([(t, f"l{i:03}") for i, t in enumerate(texts)], "text string, lang string").repartition(3)
    names, table = language.train(docs)
    assert names == [f"l{i:03}" for i in range(300)] and len(table) == language.BUCKETS
    assert [language.identify(t, names, table)[0] for t in texts[:40]] == names[:40]


def test_table_is_the_smoothed_count(spark):
    docs = spark.createDataFrame([("ab ab", "x"), ("ab cd", "y"), ("", "x"), (None, "x"), ("zz", None)], "text string, lang string")
    names, table = language.train(docs)
    counts = np.stack([np.bincount(language.grams(t), minlength=len(table)) for t in ("ab ab", "ab cd")], 1) + np.stack([np.bincount(language.grams(t), minlength=len(table)) for t in ("", "")], 1) * [1, 0] + 0.5
    want = counts / counts.sum(axis=0)
    assert names == ["x", "y"] and np.allclose(table[np.arange(len(table))], want) and table[np.zeros(0, np.int64)].shape == (0, 2)
    none = language.train(docs.filter("false"))
    assert none[0] == [] and language.identify("text", *none)[0] == language.UNKNOWN
