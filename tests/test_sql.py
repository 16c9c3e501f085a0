import pytest
from pyspark.sql import functions as F
from test_policy import CASES

from sealedspark import policy, sql, vectors


@pytest.fixture(scope="module")
def known(spark):
    sql.register(spark)
    sql.register(spark)
    return spark


def test_allows(known):
    rows = [(p, a) for p, a, _ in CASES] + [(None, ["a:1"]), ("a:1", None), ("((", ["a:1"]), ("a:1", [None, " A:1 "])]
    df = known.createDataFrame(rows, "p string, a array<string>")
    got = [r.ok for r in known.sql("SELECT sealed_allows(p, a) AS ok FROM {df}", df=df.coalesce(1)).collect()]
    assert got == [w for _, _, w in CASES] + [False, False, False, True]


def test_policy_leaves(known):
    df = known.createDataFrame([(1, "a:1 OR 2-of(b:2, c:3 AND d:4)"), (2, "a:1"), (3, "(("), (4, None)], "i int, p string")
    got = known.sql("SELECT i, l.token, l.depth FROM {df} AS d, LATERAL sealed_policy_leaves(d.p) AS l", df=df).collect()
    assert {tuple(r) for r in got} == {(1, "a:1", 1), (1, "b:2", 2), (1, "c:3", 3), (1, "d:4", 3), (2, "a:1", 0)}


def test_sentences_and_spans(known):
    df = known.createDataFrame([(1, " One  two.\n\nThree! "), (2, ""), (3, None)], "i int, t string")
    got = known.sql("SELECT i, s.pos, s.sentence FROM {df} AS d, LATERAL sealed_sentences(d.t) AS s ORDER BY 1, 2", df=df).collect()
    assert [tuple(r) for r in got] == [(1, 0, "One  two."), (1, 1, "Three!")]
    at = known.sql("SELECT i, sealed_resolve_spans(t, array('One two.', 'Three!')) AS s FROM {df} ORDER BY i", df=df).collect()
    assert [(x.start, x.end) for x in at[0].s] == [(1, 10), (12, 18)] and at[1].s is None and at[2].s is None


def test_scalar_functions_equal_the_library(known):
    rows = [([3.0, 4.0], [1.0, 0.0], " Role : Doctor , dept:X,Guest, guest,, "), ([0.0, 0.0], [1.0, 2.0], ""), ([0.125, -0.335], [0.005, 0.015], None)]
    df = known.createDataFrame(rows, "a array<double>, b array<double>, t string")
    got = known.sql("SELECT sealed_cosine(a, b) AS c, sealed_quantize(b, 2) AS q, sealed_attrs(t) AS t, sealed_norm_ws(t) AS w FROM {df}", df=df.coalesce(1)).collect()
    want = df.coalesce(1).select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.quantize(F.col("b"), 2).alias("q"), policy.parse_caller(F.col("t")).alias("t")).collect()
    assert [(r.c, r.q, r.t) for r in got] == [(pytest.approx(r.c), r.q, r.t) for r in want]
    assert got[0].w == "Role : Doctor , dept:X,Guest, guest,,"
