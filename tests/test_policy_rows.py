import random

import pytest
from pyspark.sql import functions as F

from sealedspark import catalog, layout, policy, policy_rows, retrieval


def met(node, held):
    if isinstance(node, policy.Leaf):
        return node.token in held
    n = sum(met(p, held) for p in node.parts)
    return n >= (len(node.parts) if isinstance(node, policy.All_) else 1 if isinstance(node, policy.Any_) else node.k)


def make(rnd, depth):
    if depth == 0 or rnd.random() < 0.3:
        return f"t:{rnd.randint(0, 8)}"
    parts = [make(rnd, depth - 1) for _ in range(rnd.randint(1, 4))]
    return rnd.choice(["({})".format(" AND ".join(parts)), "({})".format(" OR ".join(parts)), f"{rnd.randint(1, 3)}-of({', '.join(parts)})"])


SF = "/root/testdata/sf0.001"
BAD = ["broken (", "a:1 and b:2", "", "0-of(a:1)", "(" * 3000 + "a:1" + ")" * 3000]


@pytest.fixture(scope="module")
def case(spark):
    rnd = random.Random(1)
    texts = sorted({make(rnd, rnd.randint(0, 4)) for _ in range(120)}) + ["t:1", "5-of(t:1, t:2)", "2-of(t:1, t:1)"]
    callers = [(i, [f" T:{x} " for x in range(9) if rnd.random() < 0.4] + ([None] if i % 3 else [])) for i in range(25)] + [(90, None), (91, []), (1, ["t:1"]), (1, ["t:1"])]
    p = spark.createDataFrame([(t, 1, "x") for t in texts + BAD + texts[:5]] + [(None, 1, "x")], "policy string, id int, leaves string")
    return texts, callers, p, spark.createDataFrame(callers, "caller_id long, attrs array<string>")


def test_equals_brute_force_and_the_compiled_form(spark, case):
    texts, callers, p, c = case
    want = {(i, t) for i, attrs in callers for t in texts if met(policy.parse(t), {a.strip().lower() for a in attrs or () if a})}
    got = policy_rows.satisfied(c, p).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want
    clean = c.select("caller_id", policy.normalize_attrs(F.filter("attrs", lambda a: a.isNotNull())).alias("attrs"))
    assert {tuple(r) for r in policy.satisfied(clean, texts + BAD).collect()} == want


def test_min_attrs_and_quarantine(spark, case):
    texts, _, p, _ = case
    assert {r.policy: r.min_attrs for r in policy_rows.min_attrs(p).collect()} == {t: policy.parse(t).min_attrs() for t in texts}
    bad = {r.policy: r.reason for r in policy_rows.quarantine(p).collect()}
    assert set(bad) == set(BAD) and all(bad.values())


def test_empty_tables(spark, case):
    _, _, p, c = case
    assert policy_rows.satisfied(c.limit(0), p).count() == 0 == policy_rows.satisfied(c, p.limit(0)).count()
    assert policy_rows.min_attrs(p.limit(0)).count() == 0


def test_witnesses_avoid_frequent_tokens(spark):
    held = {"role:all": 1_000_000, "team:1": 5, "team:2": 6, "area:1": 900}
    text = "role:all AND 2-of(team:1, team:2, area:1) OR 4-of(team:1, team:2)"
    assert policy_rows._witness(policy.parse(text), held) == (11, ["team:1", "team:2"])


def test_a_gate_over_a_table_of_policies(spark):
    docs = spark.createDataFrame([(i, f"own:{i} OR role:boss", [float(i), 1.0]) for i in range(20)] + [(90, None, [1.0, 1.0]), (91, "((", [1.0, 1.0])], "doc_id long, policy string, vec array<double>")
    asks = spark.createDataFrame([(1, ["own:3"], [1.0, 0.0]), (2, ["role:boss"], [1.0, 0.0]), (3, ["own:99"], [1.0, 0.0])], "query_id long, attrs array<string>, vec array<double>")
    got = retrieval.rank_quantized(docs, asks, docs, 3).collect()
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got} == {(1, 3, 1), (2, 19, 1), (2, 18, 2), (2, 17, 3)}
    gated = policy_rows.gate(docs, asks.select(F.col("query_id").alias("caller_id"), "attrs")).groupBy("caller_id").count()
    assert {tuple(r) for r in gated.collect()} == {(1, 1), (2, 20)}


def test_no_table_of_policies_or_callers_is_broadcast_by_its_estimated_size(spark, case):
    """Estimates come from the files' columns: trees and attributes made from them pass for small."""
    texts, _, p, c = case
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (policy_rows.satisfied(c, p), catalog.QUERIES["policy_min_attrs"](spark, SF), catalog.QUERIES["quarantined_policies"](spark, SF)):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)
    few, many = (p.join(layout.broadcast_if_few(p.select("policy"), n), "policy") for n in (10_000, 1))
    assert "BroadcastHashJoin" in plan(few) and "SortMergeJoin" in plan(many)


def test_documents_meet_callers_without_a_join_of_texts(spark):
    """Pairs were joined with texts and trees; now they are judged where a witness brings both sides together."""
    plan = catalog.QUERIES["table_policies"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_texts_of_one_shape_and_tokens_dealt_over_addresses(spark, monkeypatch):
    for name, n in (("TOGETHER", 3), ("MANY", 2), ("SAMPLED", 1), ("CLASS", 4)):
        monkeypatch.setattr(policy_rows, name, n, raising=False)
    shapes = ["t:{0}", "T:{0} OR t:{1}", '2-of(t:{0}, "t:{1}", t:{2} OR t:{0})', "t : {0} AND t:{1}", '"t:{0}" AND (t:1 OR t:{2})', "t:{0} x AND t:1", "a:b:{0} OR t:{1}",
              "4-of(t:{0}, t:{1}) OR t:{2}", "t:{0} AND t:{1} OR t:{1} AND t:{2}", "t:{0} and t:1", "\x01 OR t:{0}", "2-of(t:{0}, t:{0})", "t:1 AND é:{0} OR t:{2}", "t:{0} OR \"b c:{1}\""]
    docs = [(i, shapes[i % len(shapes)].format(i % 7, i % 5, i % 3)) for i in range(500)] + [(900, None), (901, ""), (902, "t:1 OR"), (903, "t:2"), (904, "t:2")]
    rnd = random.Random(4)
    held = [sorted({f"t:{x}" for x in range(7) if rnd.random() < 0.4} | rnd.choice([set(), {"a:b:1"}, {"b c:2", 'x:"y'}, {"é:1"}])) for _ in range(12)]
    callers = [(i, held[i % 12]) for i in range(30)] + [(31, [f"n:{x}" for x in range(80)] + ["t:2"])]

    def grants(text, attrs):
        try:
            return text is not None and met(policy.parse(text), set(attrs))
        except policy.PolicyError:
            return False

    want = sorted((d, c) for d, text in docs for c, attrs in callers if grants(text, attrs))
    d = spark.createDataFrame(docs, "doc_id long, policy string").repartition(2)
    for rows in (callers, callers + [(0, ["t:1", "t:1"]), (0, held[0])]):
        got = policy_rows.granted(d, spark.createDataFrame(rows, "caller_id long, attrs array<string>")).collect()
        extra = [] if rows is callers else [(k, 0) for k, text in docs if grants(text, ["t:1"])]
        assert sorted((r.doc_id, r.caller_id) for r in got) == sorted(set(want) | set(extra))
