"""The test tables as the queries read them, and the policies and callers they use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The policy of an embedding by its label (0-9), and the callers of the queries.
POLICIES = ["role:doctor AND dept:cardio", "role:nurse", "2-of(role:nurse, clearance:2, role:pharmacist)",
            "role:doctor OR role:patient", "role:patient"]
CALLERS = [(0, ["role:nurse"]), (1, ["role:doctor", "dept:cardio"]), (2, ["clearance:2", "role:pharmacist"]),
           (3, ["role:patient"]), (4, ["role:visitor"])]
HOLDS = {0: [1], 1: [0], 2: [2], 3: [1, 3], 4: [3]}  # policy -> callers, worked out by hand for the oracles


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    names = F.array(*map(F.lit, POLICIES))
    return e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), F.get(names, F.col("label") % 5).alias("policy"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose vec_id is divisible by 20 is a query, asked by caller vec_id / 20 % 5."""
    callers = spark.createDataFrame(CALLERS, "caller long, attrs array<string>")
    e = read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), F.expr("vec_id div 20 % 5").alias("caller"))
    return q.join(F.broadcast(callers), "caller").drop("caller")
