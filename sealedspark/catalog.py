"""Queries over the test tables and the SQL they are checked against, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealedspark import catalog_policies, catalog_responses, catalog_sql, catalog_store, catalog_streams, policy, retrieval, vectors
from sealedspark.catalog_tables import CALLERS, HOLDS, POLICIES, read, requests, vector_docs
from sealedspark.layout import pin, spread


def authorized_topk(spark, sf_dir):
    return retrieval.rank_quantized(vector_docs(spark, sf_dir), requests(spark, sf_dir), POLICIES, 5)


def unfiltered_topk(spark, sf_dir):
    return retrieval.rank_quantized(vector_docs(spark, sf_dir), requests(spark, sf_dir), None, 5)


def hit_rate_by_query(spark, sf_dir):
    return retrieval.hit_rate(authorized_topk(spark, sf_dir), unfiltered_topk(spark, sf_dir))


def cosine_topk(spark, sf_dir):
    r = retrieval.rank_plain(vector_docs(spark, sf_dir), requests(spark, sf_dir), POLICIES, 5)
    return r.withColumn("score", F.round("score", 6))


def rank_comparison(spark, sf_dir):
    """Dialogue and plain store against proofs and sealed store: hits of both rankings measured against the unfiltered
    one, rounds until a level is granted over all users, and the share of damaged documents that is found."""
    found = {"baseline": retrieval.rank_plain(vector_docs(spark, sf_dir), requests(spark, sf_dir), POLICIES, 5), "improved": authorized_topk(spark, sf_dir)}
    rounds = catalog_responses.rounds_until_grant(spark, sf_dir).agg(F.avg("rounds")).first()[0]
    rates = catalog_store.detection_rates(spark, sf_dir).first()
    # a proof is one message, checked once
    table = retrieval.compare(found, unfiltered_topk(spark, sf_dir), {"baseline": rounds, "improved": 1}, rates.asDict())
    return table.withColumn("value", F.round("value", 6))


def gated_documents(spark, sf_dir):
    """Documents by source and language, and the callers that may read them."""
    rule = {"en": "role:nurse OR role:doctor", "de": "2-of(role:doctor, dept:cardio, clearance:2)", "fr": "role:patient"}
    of = F.create_map(*(F.lit(x) for pair in rule.items() for x in pair))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.try_element_at(of, F.col("lang")).alias("policy"))
    callers = spark.createDataFrame(CALLERS, "caller_id long, attrs array<string>")
    return retrieval.gate(docs, callers, list(rule.values())).select("doc_id", "caller_id")


def l2_normalized(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding"), 40).alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


def hash_search(spark, sf_dir):
    """Every document whose doc_id is divisible by 20 asks for the five nearest by hashed bag of words."""
    v = pin(vectors.hash_vectors(read(spark, sf_dir, "documents"), 32, normalize=False))
    r = retrieval.nearest_counts(spread(v), v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vec"), 5)
    return r.withColumn("score", F.round("score", 6))


def caller_facts(spark, sf_dir):
    """What callers made from documents hold: their tokens, roles, first language, and whether a prefix is there."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.array(F.concat(F.lit(" Lang:"), "lang"), F.concat(F.lit("SOURCE:"), "source"), F.lit("guest"), F.lit("Guest ")).alias("raw"))
    a = d.select("doc_id", policy.normalize_attrs(F.concat("raw", policy.from_roles(F.array(F.lit("Nurse"), F.lit("Reader"))))).alias("attrs"))
    return a.select(
        "doc_id", F.size("attrs").alias("n"), policy.get_value(F.col("attrs"), "lang").alias("lang"), policy.has_prefix(F.col("attrs"), "source:w").alias("w_source"),
        F.array_join(policy.roles(F.col("attrs")), "|").alias("roles"), F.array_contains("attrs", "guest").alias("guest"))


def quantized_vectors(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.quantize(F.col("embedding"), 2)).alias("pos", "q"))
    return e.groupBy("vec_id").agg(F.sum("q").alias("total"), F.sum(F.col("q") * (F.col("pos") + 1)).alias("weighted"))


def hash_embedding(spark, sf_dir):
    return vectors.hash_embed(read(spark, sf_dir, "documents"), 768)


_QUANT = "list_transform({}, lambda x: round_even(x::DOUBLE * 100, 0)::BIGINT)"
_TOPK = """WITH d AS (SELECT vec_id, label % 5 AS p, {qe} AS v FROM embeddings),
ok(p, c) AS (VALUES {ok}),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_sum(list_transform(list_zip(d.v, q.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM d JOIN d AS q ON q.vec_id % 20 = 0 {gate}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5"""
_OK = ", ".join(f"({p}, {c})" for p, cs in HOLDS.items() for c in cs)
_GATE = "JOIN ok ON ok.p = d.p AND ok.c = q.vec_id // 20 % 5"
_AUTH = _TOPK.format(qe=_QUANT.format("embedding"), ok=_OK, gate=_GATE)
_FREE = _TOPK.format(qe=_QUANT.format("embedding"), ok=_OK, gate="")

_COS = f"""WITH d AS (SELECT vec_id, label % 5 AS p, embedding::DOUBLE[] AS v FROM embeddings), ok(p, c) AS (VALUES {_OK}),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_cosine_similarity(d.v, q.v) AS score FROM d JOIN d AS q ON q.vec_id % 20 = 0 {_GATE}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""
_RATE = "SELECT avg(h) FROM (SELECT count(f.doc_id) / count(*) AS h FROM ({free}) t LEFT JOIN ({way}) f ON f.query_id = t.query_id AND f.doc_id = t.doc_id GROUP BY t.query_id)"
QUERIES: dict = {
    "authorized_topk": authorized_topk,
    "cosine_topk": cosine_topk,
    "rank_comparison": rank_comparison,
    "gated_documents": gated_documents,
    "l2_normalized": l2_normalized,
    "hash_search": hash_search,
    "caller_facts": caller_facts,
    "unfiltered_topk": unfiltered_topk,
    "hit_rate_by_query": hit_rate_by_query,
    "quantized_vectors": quantized_vectors,
    "hash_embedding": hash_embedding,
}
ORACLES: dict = {
    "authorized_topk": _AUTH,
    "cosine_topk": _COS,
    "rank_comparison": f"""SELECT 'baseline' AS way, 'verification_rounds' AS metric, round(avg(rounds), 6) AS value FROM ({catalog_responses.ORACLES["rounds_until_grant"]})
UNION ALL SELECT 'improved', 'verification_rounds', 1.0
UNION ALL SELECT 'baseline', 'tamper_detection_rate', round(baseline, 6) FROM ({catalog_store.DETECTED})
UNION ALL SELECT 'improved', 'tamper_detection_rate', improved FROM ({catalog_store.DETECTED})
UNION ALL SELECT 'baseline', 'authorized_hit_rate', round(({_RATE.format(free=_FREE, way=_COS)}), 6)
UNION ALL SELECT 'improved', 'authorized_hit_rate', round(({_RATE.format(free=_FREE, way=_AUTH)}), 6)""",
    "gated_documents": "SELECT doc_id, c::BIGINT AS caller_id FROM documents JOIN (VALUES ('en', 0), ('en', 1), ('de', 1), ('fr', 3)) ok(l, c) ON lang = l",
    "l2_normalized": """WITH e AS (SELECT vec_id, (embedding::DOUBLE[])[1:40] AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e)
SELECT vec_id, (unnest(generate_series(1, 40)) - 1)::INT AS pos, round(unnest(v) / n, 6) AS x FROM n""",
    "hash_search": """WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents),
b AS (SELECT doc_id, ('0x' || substr(md5(word), 31, 2))::BIGINT % 32 AS bucket, count(*)::DOUBLE AS n FROM w WHERE word <> '' GROUP BY ALL),
s AS (SELECT d.doc_id, coalesce(sqrt(sum(n * n)), 1) AS z FROM documents d LEFT JOIN b USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS query_id, c.doc_id, sum(a.n * c.n) AS x FROM b a JOIN b c USING (bucket) WHERE a.doc_id % 20 = 0 GROUP BY 1, 2),
t AS (SELECT q.doc_id AS query_id, d.doc_id, coalesce(x, 0) / (q.z * d.z) AS score FROM s q JOIN s d ON q.doc_id % 20 = 0 LEFT JOIN p ON p.query_id = q.doc_id AND p.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM t)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
    "caller_facts": """SELECT doc_id, 5 AS n, lower(lang) AS lang, lower(source) LIKE 'w%' AS w_source, 'nurse|reader' AS roles, true AS guest FROM documents""",
    "unfiltered_topk": _FREE,
    "hit_rate_by_query": f"""SELECT t.query_id, count(f.doc_id) / count(*) AS hit_rate FROM ({_FREE}) t
LEFT JOIN ({_AUTH}) f ON f.query_id = t.query_id AND f.doc_id = t.doc_id GROUP BY 1""",
    "quantized_vectors": f"""WITH v AS (SELECT vec_id, {_QUANT.format("embedding")} AS q FROM embeddings)
SELECT vec_id, list_sum(q)::BIGINT AS total, list_sum(list_transform(q, lambda x, i: x * i))::BIGINT AS weighted FROM v""",
    "hash_embedding": """WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents),
b AS (SELECT doc_id, [('0x' || substr(md5(word), 1, 8))::BIGINT, ('0x' || substr(md5(word), 9, 8))::BIGINT,
  ('0x' || substr(md5(word), 17, 8))::BIGINT, ('0x' || substr(md5(word), 25, 8))::BIGINT] AS p FROM w WHERE word <> '')
SELECT doc_id, (((p[1] % 768 * 256 + p[2]) % 768 * 256 + p[3]) % 768 * 256 + p[4]) % 768 AS bucket, count(*) AS n FROM b GROUP BY 1, 2""",
}
_ALL = _AUTH.rpartition("\nSELECT")[0]
QUERIES |= catalog_policies.QUERIES | catalog_responses.QUERIES | catalog_store.QUERIES | catalog_sql.QUERIES | catalog_streams.QUERIES
ORACLES |= catalog_policies.ORACLES | catalog_responses.ORACLES | catalog_store.ORACLES | catalog_sql.ORACLES | {
    "sealed_topk": _AUTH,
    "streamed_answers": _AUTH,
    "streamed_beliefs": catalog_responses.ORACLES["posterior_by_round"],
    "sealed_scores": _ALL + "\nSELECT query_id, doc_id, score, round(score / 10000.0::DOUBLE, 6) AS cosine FROM s",
}
