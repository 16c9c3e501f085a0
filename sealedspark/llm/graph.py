"""Connected components by contraction, wholly in Spark joins over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealedspark.llm.common import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """The component of every node of `edges` (long columns a, b): columns node, comp (its smallest node).

    Each round every root takes the smallest root beside it, pointers are followed once, and edges are
    rewritten between roots, so that the number of live roots at least halves. Null ends and loops are
    ignored. An empty input gives an empty result.
    """
    live = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    nodes = cut(live.selectExpr("explode(array(a, b)) AS node").distinct().select("node", F.col("node").alias("comp")))
    while not live.isEmpty():
        both = live.selectExpr("explode(array(struct(a AS u, b AS v), struct(b AS u, a AS v))) AS e").select("e.*")
        hook = cut(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to")))
        # a root that hooks on to another takes the latter's choice too
        jump = hook.join(hook.select(F.col("u").alias("to"), F.col("to").alias("to2")), "to", "left")
        step = cut(jump.select("u", F.coalesce("to2", "to").alias("to")))
        nodes2 = cut(nodes.join(step.withColumnRenamed("u", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
        at = lambda c: step.select(F.col("u").alias(c), F.col("to").alias(f"{c}_to"))
        moved = live.join(at("a"), "a", "left").join(at("b"), "b", "left")
        live2 = cut(moved.select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")).where("a <> b").distinct())
        drop(hook, step, nodes, live)
        nodes, live = nodes2, live2
    drop(live)
    return nodes
