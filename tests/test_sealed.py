import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sealedspark import ipfe, retrieval
from sealedspark.modular import Field

POLICIES = ["role:a", "role:b OR role:c", "role:d"]
ROLES = [["role:a"], ["role:b"], ["role:c", "role:a"], ["role:x"]]
MAY = {0: {0}, 1: {1}, 2: {0, 1}, 3: set()}


def sealed(public, vectors):
    make = ipfe.encrypt(public, F.col("v"))
    return vectors.select("doc_id", "policy", make.alias("ct"))


def plain_ct(scheme, v):
    p, g, r = scheme.public.p, scheme.public.g, random.randrange(1 << 40)
    return [pow(g, r, p), *(pow(h, r, p) * pow(g, int(x), p) % p for h, x in zip(scheme.public.mpk, v, strict=True))]


@pytest.mark.parametrize("bits", [40, 64, 128, 200])
def test_products_of_limbs_equal_those_of_integers(bits):
    p = (1 << bits) - 59
    f = Field(p)
    edge = [0, 1, 2, p - 1, p - 2, p // 2, p // 2 + 1, (1 << bits - 1) - 1]
    x = edge * len(edge) + [random.randrange(p) for _ in range(300)]
    y = [e for e in edge for _ in edge] + [random.randrange(p) for _ in range(300)]
    assert f.fits and f.numbers(f.of(x)) == x
    a, b = f.of(x), f.of(y)
    for _ in range(30):
        x = [i * j % p for i, j in zip(x, y, strict=True)]
        assert f.numbers(f.times(a, b, a)) == x
        assert abs(a[:-1] / f.weight[: f.size - 1]).max() <= (1 << 23) + 8


def test_no_larger_prime_than_sums_allow():
    assert not Field((1 << 400) - 593).fits


@pytest.mark.parametrize("most", [1, 100, 300_000])
def test_shared_powers_give_every_score(monkeypatch, most):
    """No pair is multiplied by itself, whatever the size of the components; scores beyond the table are found too."""
    monkeypatch.setattr(ipfe, "inner_products", None)
    scheme = ipfe.Scheme.setup(3, 64)
    if most > 100:
        scheme = ipfe.Scheme(ipfe.Public(scheme.public.p, scheme.public.g, scheme.public.mpk, 3), scheme.msk)
    rnd = np.random.default_rng(3)
    q = rnd.integers(-most, most + 1, (40, 3)) if most <= 100 else np.where(rnd.random((40, 3)) < 0.1, most, 0)
    v = rnd.integers(-100, 101, (9, 3)) if most <= 100 else rnd.integers(-3, 4, (9, 3))
    if most == 100:
        q[0], v[0] = 100, 100
    keys = [scheme.key(x).to_bytes(8, "big") for x in q.tolist()]
    asked = ipfe.Requests(scheme.public, keys, q)
    asked.most = 4  # several tables
    assert (asked.scores([plain_ct(scheme, x) for x in v]) == q @ v.T).all()


def test_a_chunk_is_held_at_once():
    """What leaves a worker comes in batches that do not grow with its documents."""
    scheme, rnd = ipfe.Scheme.setup(2, 64), np.random.default_rng(4)
    q, v = rnd.integers(-9, 10, (600, 2)), rnd.integers(-9, 10, (700, 2))
    shared = SimpleNamespace(value=(np.arange(600) * 20, [scheme.key(x).to_bytes(8, "big") for x in q.tolist()], q, [np.arange(600), np.arange(0, 600, 2)]))
    ct = [[x.to_bytes(8, "big") for x in plain_ct(scheme, x)] for x in v]
    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array(ct, pa.list_(pa.binary())), pa.array([i % 2 for i in range(700)], pa.int32())], names=["doc_id", "ct", "at"])
    made = list(retrieval._scored(scheme.public, shared, None)(iter([batch])))
    assert max(map(len, made)) <= (1 << 16) + retrieval.CHUNK * 600
    got = {(a, b): s for m in made for a, b, s in zip(*(c.to_pylist() for c in m.columns), strict=True)}
    assert got == {(int(i) * 20, d): int(q[i] @ v[d]) for d in range(700) for i in range(0, 600, 1 + d % 2)}


@pytest.mark.parametrize("case", ["one block", "blocks", "pairs"])
@pytest.mark.parametrize("named", ["long", "string"])
def test_the_best_are_taken_where_pairs_are_scored(spark, monkeypatch, case, named):
    """The k best of a partition leave the scoring, not a row a pair; the ranking is that of all pairs."""
    scheme, rnd = ipfe.Scheme.setup(4, 64), random.Random(6)
    vec = lambda: [rnd.randrange(-2, 3) for _ in range(4)]
    docs, asks = [(i, vec(), POLICIES[i % 3]) for i in range(200)] + [(500, vec(), None)], [(i, vec(), ROLES[i % 4]) for i in range(48)]
    d = sealed(scheme.public, spark.createDataFrame(docs, "doc_id long, v array<long>, policy string").repartition(2).withColumn("doc_id", F.col("doc_id").cast(named)))
    r = spark.createDataFrame(asks, "query_id long, q array<long>, attrs array<string>")
    monkeypatch.setattr(retrieval, "MAX_REQUESTS", 20 if case == "blocks" else 1000)
    if case == "pairs":
        monkeypatch.setattr(retrieval, "MAX_GRANTS", 3)
    made, best = [], retrieval._best
    monkeypatch.setattr(retrieval, "_best", lambda scored, k: made.append(scored.count()) or best(scored, k))
    want = {(q, i, sum(a * b for a, b in zip(x, v, strict=True))) for q, x, _ in asks for i, v, p in docs if p and POLICIES.index(p) in MAY[q % 4]}
    assert {(x.query_id, int(x.doc_id), x.score) for x in retrieval.sealed_pairs(scheme, d, r, POLICIES).collect()} == want
    top = {q: sorted((-s, named == "string" and str(i) or i) for p, i, s in want if p == q)[:3] for q, *_ in asks}
    got = retrieval.rank_sealed(scheme, d, r, POLICIES, 3).collect()
    assert sorted((x.query_id, x["rank"], -x.score, x.doc_id) for x in got) == [(q, n, *x) for q in top for n, x in enumerate(top[q], 1)]
    if named == "long" and case != "pairs":
        assert 0 < sum(made) <= 3 * 2 * 48 < len(want)


def asked_of(scheme, q):
    return ipfe.Requests(scheme.public, [scheme.key(x).to_bytes(8, "big") for x in q.tolist()], q)


@pytest.mark.parametrize("rank", [4, 2, 1])
def test_powers_do_not_grow_with_the_requests(monkeypatch, rank):
    """Only independent requests are decrypted; the scores of all others are combinations of theirs, exactly."""
    scheme, rnd, made = ipfe.Scheme.setup(4, 64), np.random.default_rng(7), []
    log = ipfe.Requests._log
    monkeypatch.setattr(ipfe.Requests, "_log", lambda self, x: made.append(x.shape[1]) or log(self, x))
    q = rnd.integers(-9, 10, (500, rank)) @ rnd.integers(-3, 4, (rank, 4))
    q[0] = 0
    v = rnd.integers(-100, 101, (200, 4))
    asked = asked_of(scheme, q)
    assert (asked.scores([plain_ct(scheme, x) for x in v]) == q @ v.T).all()
    assert sum(made) == np.linalg.matrix_rank(q) * 200


def test_keys_of_other_requests_and_damaged_ciphertexts_are_errors_still():
    scheme, rnd = ipfe.Scheme.setup(3, 64), np.random.default_rng(8)
    q, v = rnd.integers(-9, 10, (300, 3)), rnd.integers(-100, 101, (60, 3))
    cts = [plain_ct(scheme, x) for x in v]
    for at in range(0, 300, 50):
        asked = asked_of(scheme, q)
        asked.keys[at] = (int.from_bytes(asked.keys[at], "big") ^ 1).to_bytes(8, "big")
        assert asked.basis is None
    other = np.concatenate([q[:1] + 1, q[1:]])
    with pytest.raises(ValueError):
        ipfe.Requests(scheme.public, [scheme.key(x).to_bytes(8, "big") for x in other.tolist()], q).scores(cts)
    cts[17][2] = cts[17][2] * pow(scheme.public.g, 1 << 50, scheme.public.p) % scheme.public.p
    with pytest.raises(ValueError):
        asked_of(scheme, q).scores(cts)


def test_scores_that_are_no_whole_combination_are_decrypted():
    """The component is 1/2 in the exponent: a basis of even requests cannot tell, the odd ones are out of range."""
    scheme = ipfe.Scheme.setup(1, 64)
    q = np.array([[2 * i] for i in range(-50, 50)] + [[1]])
    half = pow(scheme.public.g, pow(2, -1, (scheme.public.p - 1) // 2), scheme.public.p)
    cts = [plain_ct(scheme, [x % 100]) for x in range(200)]
    assert (asked_of(scheme, q).scores(cts) == q @ (np.arange(200) % 100)[None]).all()
    cts[5][1] = cts[5][1] * half % scheme.public.p
    with pytest.raises(ValueError):
        asked_of(scheme, q).scores(cts)
    assert (asked_of(scheme, q[:-1]).scores(cts)[:, 5] == q[:-1, 0] * 11 // 2).all()


@pytest.mark.parametrize("k", [None, 2])
def test_blocks_of_sealed_requests_give_all_pairs(spark, monkeypatch, k):
    scheme, rnd = ipfe.Scheme.setup(2, 64), random.Random(9)
    monkeypatch.setattr(retrieval, "MAX_REQUESTS", 10)
    docs, asks = [(i, [rnd.randrange(-9, 10) for _ in range(2)], "role:a") for i in range(90)], [(i, [rnd.randrange(-9, 10) for _ in range(2)], ["role:a"]) for i in range(100)]
    d = sealed(scheme.public, spark.createDataFrame(docs, "doc_id long, v array<long>, policy string").repartition(1))
    got = retrieval.sealed_pairs(scheme, d, spark.createDataFrame(asks, "query_id long, q array<long>, attrs array<string>"), ["role:a"], k).collect()
    want = {(q, i): x[0] * v[0] + x[1] * v[1] for q, x, _ in asks for i, v, _ in docs}
    assert all(want[r.query_id, r.doc_id] == r.score for r in got)
    assert len(got) == len({(r.query_id, r.doc_id) for r in got}) == (k or 90) * 100


@pytest.mark.parametrize("bits,dim,precision", [(64, 5, 2), (40, 3, 1), (101, 130, 2), (200, 4, 0), (420, 3, 1)])
def test_many_vectors_are_encrypted_at_once(spark, bits, dim, precision):
    """Each ciphertext is that of its vector, with components beyond the table too."""
    scheme, rnd, most = ipfe.Scheme.setup(dim, bits, precision), np.random.default_rng(5), 10**precision
    p, g, order = scheme.public.p, scheme.public.g, (scheme.public.p - 1) // 2
    rs = [0, 1, order - 1, *(random.randrange(order) for _ in range(60))]
    v = rnd.integers(-most, most + 1, (63, dim))
    v[0], v[1] = most, -most
    want = [[pow(g, r, p), *(pow(h, r, p) * pow(g, x, p) % p for h, x in zip(scheme.public.mpk, row, strict=True))] for r, row in zip(rs, v.tolist(), strict=True)]
    if Field(p).fits:
        assert [ipfe.numbers(c) for c in ipfe._many(scheme.public, rs, v)] == want
    assert [ipfe.numbers(ipfe._one(scheme.public, r, x)) for r, x in zip(rs, v.tolist(), strict=True)] == want
    v[7] = most + 1
    df = spark.createDataFrame([(x,) for x in v.tolist()], "v array<long>").repartition(1)
    for row, ct in df.select("v", ipfe.encrypt(scheme.public, F.col("v"))).collect():
        c, *rest = ipfe.numbers(ct)
        assert {len(x) for x in ct} == {(p.bit_length() + 7) // 8}
        assert rest == [pow(c, s, p) * pow(g, x, p) % p for s, x in zip(scheme.msk, row, strict=True)]
