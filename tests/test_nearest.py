import random

import pytest

from sealedspark import retrieval


def plain(docs, asks, k):
    def cos(a, b):
        n = [sum(x * x for x in v) ** 0.5 or 1.0 for v in (a, b)]
        return sum(x * y for x, y in zip(a, b, strict=True)) / (n[0] * n[1])

    out = set()
    for q, v in asks:
        best = sorted(((-cos(v, w), i) for i, w in docs))[:k]
        out |= {(q, i, round(-s, 9), r + 1) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("k,block", [(1, 1 << 25), (4, 1 << 25), (7, 400), (500, 1 << 25)])
def test_nearest_counts_equal_brute_force(spark, k, block):
    """Many ties (copies and multiples), zero vectors, fewer documents than k, several blocks of requests."""
    rnd = random.Random(k)
    docs = [(i, [float(rnd.randint(0, 2)) for _ in range(5)]) for i in range(150)]
    docs += [(200 + i, list(docs[3][1])) for i in range(20)] + [(300, [0.0] * 5), (301, [1e6] * 5)]
    asks = [(i, [float(rnd.randint(0, 2)) for _ in range(5)]) for i in range(30)] + [(90, [0.0] * 5), (91, docs[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, vec array<double>").repartition(3)
    q = spark.createDataFrame(asks, "query_id long, vec array<double>")
    got = retrieval.nearest_counts(d, q, k, block).collect()
    assert {(r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in got} == plain(docs, asks, k)
    assert retrieval.nearest_counts(d, q.limit(0), k).count() == 0 == retrieval.nearest_counts(d.limit(0), q, k).count()
