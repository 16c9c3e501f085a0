"""Queries that run a stream over a whole table, in folders of their own, and the SQL of what it leaves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sealedspark import retrieval, streaming
from sealedspark.catalog_responses import LEVELS
from sealedspark.catalog_tables import CALLERS, POLICIES, read, vector_docs
from sealedspark.layout import shared_dir


def _stream(spark, sf_dir, name):
    path = f"{sf_dir}/{name}.parque[t]"  # a pattern, since a file stream does not take the path of a single file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def streamed_answers(spark, sf_dir):
    """Requests that come as a stream, each answered by authorised top-5 against the stored vectors."""
    docs = vector_docs(spark, sf_dir)
    e = _stream(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    attrs = F.get(F.array(*(F.array(*map(F.lit, a)) for _, a in CALLERS)), F.expr("int(vec_id div 20 % 5)"))
    asks = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), attrs.alias("attrs"))
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rank = lambda batch: retrieval.rank_quantized(docs, batch, POLICIES, 5)
    streaming.answer_requests(asks, rank, f"{at}/out", f"{at}/ck", availableNow=True).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("query_id", "doc_id", "score", "rank")


def streamed_beliefs(spark, sf_dir):
    """The belief about each user after every event that comes in, kept as state."""
    e = _stream(spark, sf_dir, "events")
    replies = e.select(F.col("user_id").alias("subject"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("tie"), F.when(F.col("event_type").isin(LEVELS), F.col("event_type")).alias("reply"))
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    streaming.write_batches(streaming.beliefs(replies, LEVELS, {"view": 3.0}), f"{at}/out", f"{at}/ck", availableNow=True).awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    return out.select("subject", F.col("round").cast("int").alias("round"), "level", F.round("posterior", 6).alias("posterior"))


QUERIES = {f.__name__: f for f in (streamed_answers, streamed_beliefs)}
