"""The engine from SQL: `register` makes its functions known to a session, under names that begin with `sealed_`.

What SQL expressions can say is a SQL function (it is inlined into the plan); policies and span texts need Arrow
functions. `sealed_sentences` and `sealed_policy_leaves` are table functions, for LATERAL joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealedspark import grounding, policy, policy_rows

# name, parameters, result and body of the functions in SQL
FUNCTIONS = [
    ("sealed_norm_ws", "t STRING", "STRING", r"regexp_replace(regexp_replace(t, r'(?U)\s+', ' '), '^ | $', '')"),
    ("sealed_dot", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    ("sealed_norm", "v ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"),
    ("sealed_cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "sealed_dot(a, b) / (coalesce(nullif(sealed_norm(a), 0D), 1D) * coalesce(nullif(sealed_norm(b), 0D), 1D))"),
    ("sealed_quantize", "v ARRAY<DOUBLE>, bits INT", "ARRAY<BIGINT>", "transform(v, x -> CAST(rint(x * power(10D, bits)) AS BIGINT))"),
    ("sealed_attrs", "t STRING", "ARRAY<STRING>",
     r"array_distinct(filter(transform(split(t, ','), x -> lower(regexp_replace(regexp_replace(x, r'(?U)^\s+|\s+$', ''), r'(?U)\s*:\s*', ':'))), x -> x <> ''))"),
]
TABLES = [
    ("sealed_sentences", "t STRING", "pos INT, sentence STRING",
     r"SELECT p, s FROM posexplode(split(regexp_replace(t, r'(?U)^\s+|\s+$', ''), r'(?U)(?<=[.!?])\s+')) AS x(p, s) WHERE s <> ''"),
]


@lru_cache(maxsize=10_000)
def _tree(text: str) -> policy.Node | None:
    try:
        return policy.parse(text)
    except policy.PolicyError:
        return None


def _meets(node: policy.Node, held: set[str]) -> bool:
    if isinstance(node, policy.Leaf):
        return node.token in held
    n = sum(_meets(p, held) for p in node.parts)
    return n >= (len(node.parts) if isinstance(node, policy.All_) else 1 if isinstance(node, policy.Any_) else node.k)


@F.pandas_udf(T.BooleanType())
def allows(policies: pd.Series, attrs: pd.Series) -> pd.Series:
    """Whether attributes meet a policy; no or an unreadable policy, and no attributes, deny."""
    out = []
    for p, a in zip(policies, attrs, strict=True):
        node = _tree(p) if p is not None and a is not None else None
        out.append(node is not None and _meets(node, {x.strip().lower() for x in a if x is not None}))
    return pd.Series(out, dtype=bool)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
def placed(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Where the texts of spans stand in a text, in order; null if one of them does not."""
    return pd.Series([grounding._resolve(t, s if s is not None else [])[0] for t, s in zip(texts, spans, strict=True)])


class PolicyLeaves:
    """The leaves of a policy with the number of nodes above each; none for a policy that cannot be read."""

    def eval(self, text: str) -> Iterator[tuple[str, int]]:
        node = _tree(text) if text is not None else None
        for leaf in policy_rows._leaves(node) if node else ():
            yield leaf["token"], len(leaf["path"])


def register(spark: SparkSession) -> None:
    """Make the functions known to a session; doing so again changes nothing."""
    for name, given, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {result} RETURN {body}")
    for name, given, result, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS TABLE ({result}) RETURN {body}")
    spark.udf.register("sealed_allows", allows)
    spark.udf.register("sealed_resolve_spans", placed)
    spark.udtf.register("sealed_policy_leaves", F.udtf(PolicyLeaves, returnType="token string, depth int"))
