"""From text files and a JSON manifest to an encrypted index, and one query over it."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealedspark import embedding, grounding, ipfe, policy, retrieval, store, vectors
from sealedspark.layout import spread


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, policy of a JSON object from file names to policies; every policy must parse."""
    text = "\n".join(r.value for r in spark.read.text(path).collect())  # one small file, read on the driver
    rows = sorted(json.loads(text).items())
    for _, p in rows:
        policy.parse(p)
    return spark.createDataFrame(rows, "doc_id string, policy string")


def read_texts(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, text, policy of the files that a manifest names; a file that is missing is an error."""
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1).alias("doc_id"), F.col("value").alias("text"))
    both = manifest.join(files, "doc_id", "left")
    text = F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("missing document: "), "doc_id")).cast("string")).otherwise(F.col("text"))
    return both.select("doc_id", text.alias("text"), "policy")


def index(scheme: ipfe.Scheme, docs: DataFrame, key: bytes, path: str, embedder=None) -> None:
    """Embed, encrypt and store `docs` (doc_id, text, policy); ciphertexts of another length are an error on reading."""
    dim = len(scheme.msk)
    vec = embedding.embed(spread(docs), dim, embedder)
    ct = ipfe.encrypt(scheme.public, vectors.quantize(F.col("vec"), scheme.public.quant_bits))
    packed = vec.withColumn("ct", ct).select(F.col("doc_id").alias("chunk_id"), F.array_join(F.transform("ct", F.hex), "").cast("binary").alias("blob"),
                                              F.col("policy").alias("tag"), F.create_map(F.lit("dim"), F.lit(str(dim))).alias("meta"))
    store.put(packed, key, path)


def sealed_docs(spark: SparkSession, scheme: ipfe.Scheme, key: bytes, path: str) -> DataFrame:
    """doc_id, policy, ct of a stored index; chunks that cannot be read are left out."""
    n = 2 * ((scheme.public.p.bit_length() + 7) // 8)
    want = n * (len(scheme.msk) + 1)
    got = store.get(spark, key, path).where("reason IS NULL").select(F.col("chunk_id").alias("doc_id"), F.col("tag").alias("policy"), F.col("blob").cast("string").alias("hex"))
    ok = F.when(F.length("hex") != want, F.raise_error(F.concat(F.lit("a ciphertext of another length: "), "doc_id")).cast("string")).otherwise(F.col("hex"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(len(scheme.msk))), lambda i: F.unhex(F.substring(ok, i * n + 1, F.lit(n))))
    return got.select("doc_id", "policy", cut.alias("ct"))


def ask(spark: SparkSession, scheme: ipfe.Scheme, key: bytes, path: str, query: str, attrs: list[str], k: int, embedder=None) -> DataFrame:
    """The k best documents of an index that a caller may read, for one query text."""
    vec = embedding.embed_texts([query], len(scheme.msk), embedder)[0]
    one = spark.createDataFrame([(0, attrs, vec)], "query_id long, attrs array<string>, vec array<double>")
    docs = sealed_docs(spark, scheme, key, path)
    request = one.select("query_id", "attrs", vectors.quantize(F.col("vec"), scheme.public.quant_bits).alias("q"))
    return retrieval.rank_sealed(scheme, docs, request, docs.select("policy"), k)  # as many policies as documents, if it be


def grounded_answer(answer: str, found: DataFrame, texts: DataFrame) -> dict:
    """How much of an answer rests on the texts (doc_id, text) of the documents found: fraction, its ungrounded spans at
    their places in the answer, and the answer with these masked."""
    spark = found.sparkSession
    one = spark.createDataFrame([(0, 0, answer)], "id long, scope long, text string")
    chunks = texts.join(F.broadcast(found.select("doc_id")), "doc_id").select(F.lit(0).cast("long").alias("scope"), "text")
    told = one.join(grounding.report(one, grounding.ground(one, chunks)), "id")
    told = told.withColumn("at", grounding.resolve_spans(F.col("text"), F.col("spans"))["spans"])
    r = told.select("fraction", "at", grounding.redact(F.col("text"), F.col("at")).alias("redacted")).first()
    return {"fraction": r.fraction, "spans": [[x.start, x.end] for x in r["at"]], "redacted": r.redacted}


def run_record(path: str, scheme: ipfe.Scheme, attrs: list[str], query: str, found: DataFrame, began: float, ingest_s: float | None = None, **more) -> dict:
    """Write what one query did to a JSON file of the driver and return it: settings, timings (ingest_s is null where the
    index was there before), the documents found, and what else is given."""
    ranked = time.perf_counter()
    best = found.withColumn("score", retrieval.as_cosine(F.col("score"), scheme.public.quant_bits)).orderBy("rank").collect()  # k rows
    record = {
        "n": len(scheme.msk), "quant_bits": scheme.public.quant_bits, "caller": sorted(attrs), "query": query,
        "timings": {"ingest_s": ingest_s, "rank_ms": round((time.perf_counter() - ranked) * 1000, 1), "total_s": round(time.perf_counter() - began, 3)},
        "top_k": [{"doc_id": r.doc_id, "score": round(r.score, 6)} for r in best],
    } | more
    with open(path, "w") as f:
        json.dump(record, f, indent=1)
    return record
