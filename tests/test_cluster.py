"""The cluster of pages against all triples."""

import itertools
import random

from tallyframe.operators import select

FLAGS = "doc_id int, page_idx int, valid_balance boolean, valid_income boolean, valid_cash boolean, on_balance boolean, on_income boolean, on_cash boolean"


def brute(pages):
    """Window around the tightest triple by trying all of them, or around the median page."""
    kinds = [[p for p, v, _ in pages if v[k]] for k in range(3)]
    by = {p: (v, o) for p, v, o in pages}
    if not all(kinds):
        pool = sorted(itertools.chain(*kinds))
        if not pool:
            return set()
        mid = pool[len(pool) // 2]
        return {p for p in by if max(0, mid - 4) <= p < mid + 5}
    _, *best = min((max(t) - min(t), *t) for t in itertools.product(*kinds))
    out = set()
    for p in range(min(best) - 4, max(best) + 6):
        for k in range(3):
            if p in by and by[p][0][k]:
                out.add(p)
                for q in (p + 1, p + 2):
                    if q not in by or not by[q][1][k]:
                        break
                    out.add(q)
    return out


def test_against_all_triples(spark):
    rng = random.Random(8)
    docs = {}
    for d in range(250):
        rate = rng.choice([0.02, 0.1, 0.4])
        none = rng.choice([None, None, 0, 1, 2])
        docs[d] = [(p, [rng.random() < rate and k != none for k in range(3)], [rng.random() < 0.5 for _ in range(3)]) for p in range(rng.randrange(1, 60)) if rng.random() < 0.9]
    rows = spark.createDataFrame([(d, p, *v, *o) for d, pages in docs.items() for p, v, o in pages], FLAGS).repartition(3)
    got = {}
    for r in select.cluster_pages(rows, rows).collect():
        got.setdefault(r.doc_id, []).append(r.page_idx)
    assert all(len(set(v)) == len(v) for v in got.values())
    assert {d: set(v) for d, v in got.items()} == {d: b for d, pages in docs.items() if (b := brute(pages))}
    assert select.cluster_pages(rows.filter("false"), rows).count() == 0
