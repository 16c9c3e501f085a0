"""Queries over policies that lie in tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealedspark import policy, policy_rows
from sealedspark.catalog_tables import POLICIES, read
from sealedspark.layout import shuffled

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _num(c):
    return c.cast("long").cast("string")


def _customers(spark, sf_dir):
    """Customers as callers: their own key, segment, nation, and the team and area that their key lies in."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    token = lambda name, v: F.concat(F.lit(name + ":"), v)
    attrs = F.array(token("cust", _num(k)), token("Segment", F.col("c_mktsegment")), token("nation", _num(F.col("c_nationkey"))),
                    token("team", _num(F.floor(k / 16))), token(" area", _num(F.floor(k / 5))), F.lit("role:customer"))
    return c.select(k.alias("caller_id"), attrs.alias("attrs"))


def _orders(spark, sf_dir):
    """Orders as documents, each with a policy of its own: its customer, or one of the segment with two of three ties."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    segment = F.get(F.array(*map(F.lit, SEGMENTS)), (k % 5).cast("int"))
    text = F.concat(F.lit("cust:"), _num(c), F.lit(" OR (segment:"), segment, F.lit(" AND role:customer AND 2-of(team:"), _num(F.floor(c / 16)),
                    F.lit(", nation:"), _num(k % 25), F.lit(", area:"), _num(F.floor(c / 5)), F.lit("))"))
    return read(spark, sf_dir, "orders").select(k.alias("doc_id"), text.alias("policy"))


def table_policies(spark, sf_dir):
    """Every order beside the customers that may read it; there are nearly as many policies as orders."""
    return policy_rows.granted(_orders(spark, sf_dir), _customers(spark, sf_dir))


def _varied(spark, sf_dir):
    """One policy an order, of six shapes; the last two cannot be read."""
    k = _num(F.col("o_orderkey"))
    shapes = ["cust:{}", "cust:{} AND (nation:1 OR nation:2)", "2-of(cust:{}, nation:1 AND team:2, area:3)", "1-of(a:1 AND b:2 AND c:{}, 2-of(d:1, e:2)) AND f:1",
              "cust:{} and nation:1", "0-of(cust:{})"]
    texts = F.array(*(F.concat(F.lit(a), k, F.lit(b)) for a, b in (s.split("{}") for s in shapes)))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.get(texts, (F.col("o_orderkey") % 6).cast("int")).alias("policy"))


def policy_min_attrs(spark, sf_dir):
    """The fewest attributes that meet each order's policy."""
    p = _varied(spark, sf_dir)
    return p.join(shuffled(policy_rows.min_attrs(p)), "policy").select("o_orderkey", "min_attrs")


def quarantined_policies(spark, sf_dir):
    """Orders whose policy cannot be read, and why."""
    p = _varied(spark, sf_dir)
    return p.join(shuffled(policy_rows.quarantine(p)), "policy").select("o_orderkey", "reason")


def policy_matrix(spark, sf_dir):
    """Which of the few fixed policies, compiled to Columns, each customer meets; roles follow from segment and nation."""
    c = read(spark, sf_dir, "customer")
    role = F.concat(F.lit("role:"), F.get(F.array(*map(F.lit, ["doctor", "nurse", "patient", "pharmacist"])), F.col("c_nationkey") % 4))
    dept = F.when(F.col("c_mktsegment") == "BUILDING", "dept:cardio").otherwise("dept:icu")
    attrs = F.array(role, dept, F.concat(F.lit("clearance:"), _num(F.col("c_custkey") % 3)))
    return policy.satisfied(c.select(F.col("c_custkey").alias("caller_id"), attrs.alias("attrs")), POLICIES)


_TIES = "(c.c_custkey // 16 = o.o_custkey // 16)::INT + (c.c_nationkey = o.o_orderkey % 25)::INT + (c.c_custkey // 5 = o.o_custkey // 5)::INT"
_SEGMENT = "c.c_mktsegment = [" + ", ".join(f"'{s}'" for s in SEGMENTS) + "][o.o_orderkey % 5 + 1]"
_PAIR = "SELECT o_orderkey AS doc_id, c_custkey AS caller_id FROM orders o JOIN customer c ON {on}"
_MET = {
    "role:doctor AND dept:cardio": "r = 0 AND d", "role:nurse": "r = 1", "2-of(role:nurse, clearance:2, role:pharmacist)": "(r IN (1, 3)) AND k = 2",
    "role:doctor OR role:patient": "r IN (0, 2)", "role:patient": "r = 2",
}
QUERIES = {f.__name__: f for f in (table_policies, policy_min_attrs, quarantined_policies, policy_matrix)}
ORACLES = {
    # two ties are team and area, or one of the two with the nation: so every pair but the customer's own shares team or area
    "table_policies": _PAIR.format(on="c_custkey = o_custkey") + " UNION " + " UNION ".join(
        _PAIR.format(on=f"c.c_custkey // {n} = o.o_custkey // {n} AND {_SEGMENT} AND {_TIES} >= 2") for n in (16, 5)),
    "policy_min_attrs": "SELECT o_orderkey, [1, 2, 2, 2][o_orderkey % 6 + 1]::BIGINT AS min_attrs FROM orders WHERE o_orderkey % 6 < 4",
    "quarantined_policies": """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN '''and'' is not an operator' ELSE 'a threshold is at least 1' END AS reason
FROM orders WHERE o_orderkey % 6 >= 4""",
    "policy_matrix": "WITH c AS (SELECT c_custkey, c_nationkey % 4 AS r, c_mktsegment = 'BUILDING' AS d, c_custkey % 3 AS k FROM customer)\n"
    + " UNION ALL ".join(f"SELECT c_custkey AS caller_id, '{p}' AS policy FROM c WHERE {on}" for p, on in _MET.items()),
}
