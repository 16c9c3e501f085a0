from pyspark.sql import functions as F

from sealedspark import inference


def test_equal_counts_tie_after_many_rounds(spark):
    """Levels named equally often are equal exactly, in whatever order: the first is the likeliest, the prior decides."""
    order = ["b", "b", "a", None, "c", "a", "c", ""] * 150
    rows = [(s, i + 1, r) for s, x in ((1, order), (2, order[::-1])) for i, r in enumerate(x)]
    evidence = spark.createDataFrame(rows, "subject long, round long, reply string")
    last = lambda df: {r.subject: r for r in df.where(F.col("round") == len(order)).collect()}
    flat = inference.posterior(evidence, ["a", "b", "c"])
    at = flat.where(F.col("round") == len(order)).groupBy("subject").agg(F.count_distinct("posterior").alias("n")).collect()
    assert [r.n for r in at] == [1, 1]
    assert {k: r.level for k, r in last(inference.top(flat)).items()} == {1: "a", 2: "a"}
    held = last(inference.top(inference.posterior(evidence, ["a", "b", "c"], {"c": 3.0})))
    assert {k: (r.level, r.granted) for k, r in held.items()} == {1: ("c", True), 2: ("c", True)}


def test_replies_are_moved_once(spark):
    """Levels are counted in one window, so that a plan has one exchange, and a level of no weight stays null."""
    rows = [(s, i, r) for s in range(3) for i, r in enumerate(["a", None, "b", "a"], 1)]
    evidence = spark.createDataFrame(rows, "subject long, round long, reply string")
    post = inference.posterior(evidence, ["a", "b", "c"], {"c": 0.0})
    assert post._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r.round, r.level): r.posterior for r in post.where("subject = 1").collect()}
    assert len(got) == 12 and all((p is None) == (level == "c") for (_, level), p in got.items())
    assert all(abs(got[i, "a"] + got[i, "b"] - 1) < 1e-12 for i in range(1, 5)) and got[3, "a"] == got[3, "b"] < got[4, "a"]
