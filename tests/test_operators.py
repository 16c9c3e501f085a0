import random

import pytest
from oracle import compare
from pyspark.sql import functions as F

from sealedspark import catalog, grounding, integrity, ipfe, privacy, proofs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_exact_inner_products(spark):
    rnd, scheme = random.Random(3), ipfe.Scheme.setup(6, bits=64)
    rows = [([rnd.randint(-100, 100) for _ in range(6)], q := [rnd.randint(-100, 100) for _ in range(6)], scheme.key(q).to_bytes(8, "big")) for _ in range(20)]
    rows.append(([0] * 6, [0] * 6, scheme.key([0] * 6).to_bytes(8, "big")))
    df = spark.createDataFrame(rows, "v array<long>, q array<long>, sk binary")
    got = df.select("v", "q", ipfe.inner_product(scheme.public, ipfe.encrypt(scheme.public, F.col("v")), F.col("sk"), F.col("q")).alias("s")).collect()
    assert all(r.s == sum(a * b for a, b in zip(r.v, r.q)) for r in got)
    with pytest.raises(ValueError):
        scheme.key([1])


def test_gate_is_below_the_scoring(spark):
    plan = catalog.QUERIES["sealed_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    score = max(i for i, x in enumerate(lines) if "MapInArrow" in x and "score" in x)
    assert any("Join" in x for x in lines[score:])


def test_redaction_is_order_free(spark):
    df = spark.createDataFrame([("a\U0001f600bcdef", [(4, 6), (1, 2), (3, 3)])], "t string, s array<struct<start:long,end:long>>")
    for s in (F.col("s"), F.reverse("s")):
        assert df.select(grounding.redact(F.col("t"), s)).first()[0] == "a█bc██f"
    bad = [[(0, 2), (1, 3)], [(2, 1)], [(0, 99)]]
    assert all(df.select(grounding.valid_spans(F.col("t"), F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in s)))).first()[0] is False for s in bad)


def test_key_is_not_in_the_plan(spark):
    key = b"k" * 32
    df = spark.createDataFrame([(1, "c", "t", 1)], "doc_id long, ct string, tag string, version int")
    sealed = integrity.seal(df, key)
    assert "kkkk" not in sealed._jdf.queryExecution().toString()
    assert sealed.first().mac == integrity.seal(df, key, integrity.mac_sql).first().mac
    with pytest.raises(ValueError):
        integrity.seal(df, b"short")


def test_laplace_points(spark):
    df = spark.createDataFrame([(0.5,), (0.25,), (0.75,)], "u double")
    a, b, c = (r[0] for r in df.select(privacy.laplace(F.col("u"), 1.0, F.lit(1.0))).collect())
    assert a == 0 and abs(b + 0.6931471805599453) < 1e-12 and abs(b + c) < 1e-12


def test_proofs(spark):
    p, g = ipfe.safe_prime(64), 4
    t, c, s = proofs.prove("role:nurse", "x", p, g)
    rows = [("role:nurse", "x", t, c, s), ("Role:Nurse ", "x", t, c, s), ("role:nurse", "y", t, c, s), ("role:nurse", "x", t, c, str((int(s) + 1) % ((p - 1) // 2))), ("role:nurse", "x", None, c, s)]
    rows += [("role:nurse", "x", t, c, bad) for bad in ("-1", "", "x", "9" * 5000, str(int(s) + (p - 1) // 2), "\u0663")] + [(None, "x", t, c, s), ("role:nurse", None, t, c, s)]
    df = spark.createDataFrame(rows, "a string, k string, t string, c string, s string").coalesce(1)
    assert [r[0] for r in df.select(proofs.verify(p, g, *map(F.col, "aktcs"))).collect()] == [True, True] + [False] * 11
    again = df.limit(1).select(proofs.proof(p, g, F.col("a"), F.col("k")).alias("p")).first().p
    assert (again.t, again.c, again.s) == (t, c, s) == proofs.prove("role:nurse", "x", p, g)


@pytest.mark.parametrize("wrong", [0, 1, 2, 7, 300, 600])
def test_batches_name_the_wrong_proofs(wrong):
    """Wrong answers, and commitments of the wrong sign that would cancel in pairs, at any place of 600 proofs."""
    p, g = ipfe.safe_prime(64), 4
    q, rnd = (p - 1) // 2, random.Random(wrong)
    items = []
    for i in range(600):
        attr = f"source:{i % 20}"
        t, c, s = map(int, proofs.prove(attr, str(i), p, g))
        items.append((t, c, s, proofs._public(attr, p, g)))
    bad = set(rnd.sample(range(600), wrong))
    for i in bad:
        t, c, s, y = items[i]
        items[i] = (t, c, (s + 1) % q, y) if i % 2 else (p - t, c, s, y)
    assert {i for i, ok in enumerate(proofs.check(items, p, g)) if not ok} == bad
    assert [proofs._right(i, p, g) for i in items] == [i not in bad for i in range(600)]


def test_signs_are_those_of_squares():
    p = ipfe.safe_prime(32)
    assert all((proofs._jacobi(a, p) == 1) == (pow(a, (p - 1) // 2, p) == 1) for a in range(1, 300))


def test_fixed_base_and_shared_squarings():
    scheme, rnd = ipfe.Scheme.setup(5, bits=64), random.Random(1)
    p, g = scheme.public.p, scheme.public.g
    for digit in (4, 8):
        table = ipfe.FixedBase(g, p, digit)
        assert all(table.power(e) == pow(g, e, p) for e in (0, 1, 255, 256, (p - 1) // 2, p - 1))
    for e in (0, 1, -1, 500, -500, scheme.public.bound, -scheme.public.bound):
        assert ipfe.discrete_log(pow(g, e, p), g, p, scheme.public.bound) == e
    with pytest.raises(ValueError):
        ipfe.discrete_log(pow(g, scheme.public.bound + 1, p), g, p, scheme.public.bound)
    ct = [rnd.randrange(1, p) for _ in range(6)]
    for q in ([0] * 5, [3, -2, 100, -100, 1], [-1] * 5, [7] * 5):
        a, b = ipfe.Query(scheme.public, (0).to_bytes(8, "big"), q).quotient(ct, p)
        a = a * pow(ct[0], -((p - 1) // 2), p) % p
        want = 1
        for c, x in zip(ct[1:], q, strict=True):
            want = want * pow(c, x, p) % p
        assert a * pow(b, -1, p) % p == want


def test_sealed_requests_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(catalog.retrieval, "MAX_REQUESTS", 12)
    compare(spark, catalog.QUERIES["sealed_topk"], catalog.ORACLES["sealed_topk"], SF)
