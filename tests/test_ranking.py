import random

import pytest

from sealedspark import retrieval

POLICIES = ["role:a", "role:b OR role:c", "role:d"]
MAY = {"role:a": {0}, "role:b OR role:c": {1, 2}, "role:d": set()}
ROLES = [["role:a"], ["role:b"], ["role:c", "role:a2"], ["role:x"]]


@pytest.fixture(scope="module")
def case(spark):
    """Copies, zeros, large numbers, other lengths, nulls and NaN among documents and requests."""
    rnd = random.Random(5)
    vec = lambda: [round(rnd.uniform(-1, 1), 2) for _ in range(6)]
    docs = [(i, vec(), POLICIES[i % 3]) for i in range(400)]
    docs += [(1000 - i, list(docs[i % 3][1]), docs[i % 3][2]) for i in range(60)]
    docs += [(2000, [0.0] * 6, "role:a"), (2001, [1e7] * 6, "role:a"), (2002, [1.0], "role:a"), (2003, None, "role:a"), (2004, [1.0, None] * 3, "role:a")]
    docs += [(2005, [float("nan")] * 6, "role:b OR role:c"), (2006, vec(), None), (2007, vec(), "role:unknown")]
    asks = [(i, vec(), ROLES[i % 4]) for i in range(40)] + [(50, docs[3][1], ROLES[0]), (51, [0.0] * 6, ROLES[1]), (52, [1e7] * 6, ROLES[0]), (53, [1.0, None] * 3, ROLES[0])]
    d = spark.createDataFrame(docs, "doc_id long, vec array<double>, policy string").repartition(3)
    return d, spark.createDataFrame(asks, "query_id long, vec array<double>, attrs array<string>")


def rows(df):
    return {(r.query_id, r.doc_id, str(r.score), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("gated", [True, False])
@pytest.mark.parametrize("k", [1, 600])
def test_matrices_equal_pairs(spark, case, monkeypatch, gated, k):
    """Bit for bit what is found a pair at a time, in one block of requests and in several."""
    docs, asks = case
    policies = POLICIES if gated else None
    for rank in (retrieval.rank_plain, retrieval.rank_quantized):
        fine = docs if rank is retrieval.rank_plain else docs.where("doc_id <> 2005")  # NaN has no integer
        with monkeypatch.context() as m:
            m.setattr(retrieval, "LARGEST", {"bigint": -1.0, "double": -1.0})  # nothing fits a matrix
            want = rows(rank(fine, asks, policies, k))
        assert rows(rank(fine, asks, policies, k)) == want
        with monkeypatch.context() as m:
            m.setattr(retrieval, "TILE", 4)
            m.setattr(retrieval, "MAX_GRANTS", 90)
            assert rows(rank(fine, asks, policies, k)) == want


def test_a_pair_is_never_a_row(spark, case, monkeypatch):
    """What leaves the scoring is k rows a request and partition, not a row a pair."""
    docs, asks = (x.where("size(vec) = 6 AND forall(vec, v -> v IS NOT NULL AND abs(v) <= 1)") for x in case)
    made = []
    best = retrieval._best
    monkeypatch.setattr(retrieval, "_best", lambda scored, k: made.append(scored.count()) or best(scored, k))
    retrieval.rank_quantized(docs.coalesce(2), asks, None, 3).collect()
    parts = max(2, spark.sparkContext.defaultParallelism)
    assert made and sum(made) <= 3 * parts * asks.count() < docs.count() * asks.count()


def test_null_has_no_integer_but_a_place(spark):
    d = spark.createDataFrame([(1, [0.5, -0.5], "p"), (2, None, "p")], "doc_id long, vec array<double>, policy string")
    q = spark.createDataFrame([(7, [1.0, 0.0], ["p"])], "query_id long, vec array<double>, attrs array<string>")
    got = retrieval.rank_quantized(d, q, None, 5).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(1, 5000), (2, None)]
