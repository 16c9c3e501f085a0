"""Bayesian inference of a caller's level from evidence by round, from running counts of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def likelihood(reply: Column, level: Column, k: int, q: float = 0.8, p: float = 0.95) -> Column:
    """How likely a reply is at a level of k: 1/k for an evasive one (null or empty)."""
    evasive = reply.isNull() | (reply == "")
    return (
        F.when(evasive, 1 / k).when(reply == level, q * p + (1 - q) / k).otherwise(q * (1 - p) / (k - 1) + (1 - q) / k)
    )


def posterior(evidence: DataFrame, levels: list[str], prior: dict[str, float] | None = None, q: float = 0.8, p: float = 0.95) -> DataFrame:
    """subject, round, nth, level, posterior for `evidence` (subject, round, reply); a reply that is no level is an error.

    Levels differ only in how many replies named each: an evasive reply says the same of all, and so does any reply of
    the levels that it does not name. So levels named equally often are equal exactly, after any number of rounds.
    """
    k = len(levels)
    if k < 2 or set(prior or ()) - set(levels) or not (0 <= p <= 1 and 0 <= q <= 1) or p == q == 1:
        raise ValueError("two levels at least, known ones in the prior, and uncertain replies")
    w = {x: (prior or {}).get(x, 1.0) for x in levels}
    known = F.col("reply").isNull() | (F.col("reply") == "") | F.col("reply").isin(levels)
    reply = F.when(known, F.col("reply")).otherwise(F.raise_error(F.concat(F.lit("a reply is no level: "), "reply")).cast("string"))
    own, other = (likelihood(F.lit("own"), F.lit(x), k, q, p) for x in ("own", "other"))
    # one window by subject counts all levels, so that rows are moved once and stay one a reply until they are judged
    run = Window.partitionBy("subject").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    named = {f"n{i}": F.coalesce(F.sum((reply == x).cast("long")).over(run), F.lit(0)) for i, x in enumerate(levels)}
    ratio = F.coalesce(F.log(own / other), F.lit(float("-inf")))
    e = evidence.select("subject", "round", *(n.alias(c) for c, n in named.items()))
    s = [F.when(F.col(f"n{i}") > 0, F.col(f"n{i}") * ratio).otherwise(0.0) + F.log(F.lit(w[x] / sum(w.values()))) for i, x in enumerate(levels)]
    e = e.select("subject", "round", *(x.alias(f"s{i}") for i, x in enumerate(s)))
    top = F.greatest(*(f"s{i}" for i in range(k)))
    e = e.select("subject", "round", F.array(*(F.exp(F.col(f"s{i}") - top) for i in range(k))).alias("x"))
    total = sum((F.coalesce(F.col("x")[i], F.lit(0.0)) for i in range(k)), F.lit(0.0))
    e = e.select("subject", "round", total.alias("total"), F.posexplode("x").alias("nth", "x"))
    return e.select("subject", "round", "nth", F.array(*map(F.lit, levels))[F.col("nth")].alias("level"), (F.col("x") / F.col("total")).alias("posterior"))


def rounds_until(post: DataFrame, level: str, threshold: float = 0.6, max_rounds: int = 20) -> DataFrame:
    """The first round at which a level reaches the threshold; max_rounds + 1 if it never does."""
    hit = F.when((F.col("level") == level) & (F.col("posterior") >= threshold) & (F.col("round") <= max_rounds), F.col("round"))
    return post.groupBy("subject").agg(F.coalesce(F.min(hit), F.lit(max_rounds + 1)).cast("long").alias("rounds"))


def top(post: DataFrame, threshold: float = 0.6) -> DataFrame:
    """subject, round, level, posterior, granted: the likeliest level of each round, the first listed of equals."""
    best = F.max_by(F.struct("level", "posterior"), F.struct(F.round("posterior", 12), -F.col("nth")))
    out = post.groupBy("subject", "round").agg(best.alias("b")).select("subject", "round", "b.*")
    return out.withColumn("granted", F.round("posterior", 12) >= threshold)
