"""Queries written in SQL with the engine's functions, and the SQL that checks them."""

from __future__ import annotations

from sealedspark import sql
from sealedspark.catalog_tables import read


def sql_sentences(spark, sf_dir):
    """The sentences of answers, by a table function."""
    sql.register(spark)
    return spark.sql("""SELECT conv_id * 1000 + turn AS id, s.pos, s.sentence FROM {c} AS c, LATERAL sealed_sentences(c.text) AS s
        WHERE role = 'assistant'""", c=read(spark, sf_dir, "conversations"))


def sql_gate(spark, sf_dir):
    """Documents beside the customers' segments that may read them, with as many policies as there are sources and languages."""
    sql.register(spark)
    docs, customers = read(spark, sf_dir, "documents"), read(spark, sf_dir, "customer")
    return spark.sql("""WITH p AS (SELECT DISTINCT lang, source, concat('2-of(lang:', lang, ', source:', source, ', segment:building) OR segment:machinery AND lang:', lang) AS policy FROM {d}),
        c AS (SELECT DISTINCT c_mktsegment AS segment, sealed_attrs(concat('Segment : ', c_mktsegment, ', lang:EN, source:src', c_nationkey % 20)) AS attrs, c_nationkey % 20 AS n FROM {c}),
        ok AS (SELECT lang, source, segment, n FROM p JOIN c WHERE sealed_allows(policy, attrs))
        SELECT doc_id, segment, count(*) AS n FROM {d} JOIN ok USING (lang, source) GROUP BY ALL""", d=docs, c=customers)


def sql_nearest(spark, sf_dir):
    """The nearest vector of each label to every vector whose id is divisible by 100."""
    sql.register(spark)
    e = read(spark, sf_dir, "embeddings")
    return spark.sql("""WITH q AS (SELECT vec_id AS query_id, label, CAST(embedding AS ARRAY<DOUBLE>) AS v FROM {e} WHERE vec_id % 100 = 0),
        s AS (SELECT query_id, d.vec_id, sealed_cosine(v, CAST(d.embedding AS ARRAY<DOUBLE>)) AS score FROM q JOIN {e} AS d ON d.label = q.label AND d.vec_id <> query_id)
        SELECT query_id, max_by(vec_id, struct(score, -vec_id)) AS vec_id, round(max(score), 6) AS score FROM s GROUP BY query_id""", e=e)


QUERIES = {f.__name__: f for f in (sql_sentences, sql_gate, sql_nearest)}
ORACLES = {
    "sql_sentences": r"""SELECT id, (i - 1)::INT AS pos, a[i] AS sentence FROM (SELECT conv_id * 1000 + turn AS id,
 string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS a FROM conversations WHERE role = 'assistant'),
 LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i) WHERE a[i] <> ''""",
    "sql_gate": """WITH c AS (SELECT DISTINCT c_mktsegment AS segment, c_nationkey % 20 AS n FROM customer)
SELECT doc_id, segment, count(*) AS n FROM documents d JOIN c ON (d.lang = 'en')::INT + (d.source = 'src' || c.n)::INT + (segment = 'BUILDING')::INT >= 2
 OR segment = 'MACHINERY' AND d.lang = 'en' GROUP BY ALL""",
    "sql_nearest": """WITH s AS (SELECT q.vec_id AS query_id, d.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings d
 ON d.label = q.label AND d.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) SELECT query_id, arg_max(vec_id, (score, -vec_id)) AS vec_id, round(max(score), 6) AS score FROM s GROUP BY query_id""",
}
