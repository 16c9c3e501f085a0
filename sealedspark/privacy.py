"""Differential privacy: Laplace noise by inverse CDF, clamping, budgets, noisy aggregates."""

from __future__ import annotations

import secrets
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def laplace(u: Column, sensitivity: float, eps: Column) -> Column:
    """The Laplace quantile of u in (0, 1) at scale sensitivity / eps."""
    b = F.lit(float(sensitivity)) / F.greatest(eps, F.lit(1e-12))
    u = F.greatest(u, F.lit(1e-12))
    return F.when(u >= 0.5, -b * F.log(2 * (1 - u))).otherwise(b * F.log(2 * u))


def secure_uniform(like: Column, nth: int = 0) -> Column:
    """A uniform draw per row from the operating system's generator; never evaluated twice in one plan."""

    @F.pandas_udf("double")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([(secrets.randbits(53) + 0.5) / 2**53 for _ in range(len(rows))])

    return run.asNondeterministic()(like)


def clamp(x: Column, lo: float | None, hi: float | None) -> Column:
    x = x if lo is None else F.greatest(x, F.lit(lo))
    return x if hi is None else F.least(x, F.lit(hi))


def adaptive_eps(length: Column, lo: float, hi: float, default: float, full: int = 512) -> Column:
    """eps from lo to hi as a query grows to `full`; the default for an empty or null one."""
    grown = F.lit(lo) + F.lit(hi - lo) * F.least(F.lit(1.0), length / F.lit(float(full)))
    return F.when(F.coalesce(length, F.lit(0)) > 0, grown).otherwise(F.lit(default))


def fixed_eps(eps: float) -> Column:
    """The same budget for every query."""
    if not eps > 0:
        raise ValueError("a budget is positive")
    return F.lit(float(eps))


def privatise(value: Column, sensitivity: float, eps: Column, u: Column) -> Column:
    """A value with Laplace noise; `u` is a uniform draw."""
    return value + laplace(u, sensitivity, eps)


def noisy_sums(df: DataFrame, by: list[str], value: str, lo: float, hi: float, eps: float, u) -> DataFrame:
    """Per group: noisy_n, noisy_sum and noisy_avg of clamped values; no exact figure is returned.

    Half of `eps` goes to the count, half to the sum. `u` maps a column and a number to uniform draws.
    """
    sums = df.groupBy(*by).agg(F.count(value).alias("__n"), F.sum(clamp(F.col(value), lo, hi)).alias("__t"))
    half = fixed_eps(eps / 2)
    key = F.concat_ws("|", *by)
    sums = sums.withColumn("noisy_n", privatise(F.col("__n").cast("double"), 1.0, half, u(key, 0)))
    sums = sums.withColumn("noisy_sum", privatise(F.coalesce("__t", F.lit(0.0)), max(abs(lo), abs(hi)), half, u(key, 1)))
    return sums.withColumn("noisy_avg", F.col("noisy_sum") / F.greatest("noisy_n", F.lit(1.0))).drop("__n", "__t")


def _consistent(levels: list[DataFrame], name: str) -> list[DataFrame]:
    """`levels` (path, up, and a noisy column of equal variance) from the root down, with the least-squares estimate that
    makes every parent the sum of its children: first each node's own figure and its children's sum are averaged by their
    variances, from the bottom up, then what is left over is dealt to the children, from the top down."""
    z = [None] * len(levels)
    z[-1] = levels[-1].withColumn("z", F.col(name)).withColumn("v", F.lit(1.0))
    for i in range(len(levels) - 2, -1, -1):
        kids = z[i + 1].groupBy(F.col("up").alias("path")).agg(F.sum("z").alias("kz"), F.sum("v").alias("kv"))
        w = F.col("kv") / (F.col("kv") + 1)  # the weight of the own figure, whose variance is 1
        z[i] = levels[i].join(kids, "path").withColumn("z", w * F.col(name) + (1 - w) * F.col("kz")).withColumn("v", w).drop("kz", "kv")
    out = [z[0].withColumn("h", F.col("z"))]
    for child in z[1:]:
        sums = child.groupBy("up").agg(F.sum("z").alias("kz"), F.sum("v").alias("kv"))
        top = out[-1].select(F.col("path").alias("up"), F.col("h").alias("ph")).join(sums, "up")
        rest = (F.col("ph") - F.col("kz")) * F.col("v") / F.col("kv")
        out.append(child.join(top, "up").withColumn("h", F.col("z") + rest).drop("ph", "kz", "kv"))
    return [o.withColumn(name, F.col("h")).drop("z", "v", "h") for o in out]


def noisy_rollup(df: DataFrame, by: list[str], value: str, lo: float, hi: float, eps: float, u) -> DataFrame:
    """Noisy counts and sums of clamped values over all, by the first column of `by`, by the first two, and so on.

    Returns level (0 for all), the columns of `by` (as texts; null below their level), noisy_n, noisy_sum. A row counts
    once in every level, so each gets an equal part of `eps`, half of it for counts. The figures are made consistent:
    each group is exactly the sum of its parts, which also takes noise away. No exact figure is returned; which groups
    there are is. Null is a group of its own. `u` maps a column and a number to uniform draws.
    """
    cols = [F.col(c).cast("string").alias(c) for c in by]
    base = df.select(*cols, F.col(value).alias("__x")).groupBy(*by).agg(F.count("__x").alias("__n"), F.sum(clamp(F.col("__x"), lo, hi)).alias("__t"))
    part, levels = fixed_eps(eps / (2 * (len(by) + 1))), []
    path = lambda n: F.to_json(F.array(*map(F.col, by[:n]))) if n else F.lit("[]")
    for n in range(len(by) + 1):
        g = base.groupBy(*by[:n]).agg(F.sum("__n").alias("__n"), F.coalesce(F.sum("__t"), F.lit(0.0)).alias("__t"))
        g = g.withColumns({"path": path(n), "up": path(max(0, n - 1))})
        g = g.withColumn("noisy_n", privatise(F.coalesce("__n", F.lit(0)).cast("double"), 1.0, part, u(F.col("path"), 0)))
        levels.append(g.withColumn("noisy_sum", privatise(F.col("__t"), max(abs(lo), abs(hi)), part, u(F.col("path"), 1))).drop("__n", "__t"))
    done = [_consistent([x.drop(other) for x in levels], name) for name, other in (("noisy_n", "noisy_sum"), ("noisy_sum", "noisy_n"))]
    out = []
    for n, (a, b) in enumerate(zip(*done, strict=True)):
        both = a.join(b.select("path", "noisy_sum"), "path")
        out.append(both.select(F.lit(n).alias("level"), *(F.col(c) if i < n else F.lit(None).cast("string").alias(c) for i, c in enumerate(by)), "noisy_n", "noisy_sum"))
    return reduce(DataFrame.union, out)
