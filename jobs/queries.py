"""The jobs as registered queries, each run twice over a whole table into a folder of its own, and their SQL."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import audit_answers, ingest_documents
from jobs.common import new_folder
from sealedspark.catalog_responses import PLACED
from sealedspark.catalog_store import HMAC, PART, TEST_KEY


def _config(name: str) -> dict:
    """The config file that ships beside a job, as part of its code."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json")) as f:
        return json.load(f)


def job1_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, conf = new_folder(spark, "job1"), _config("ingest_documents")
    for _ in range(2):
        # a pattern, since a file stream does not take the path of a single file
        found = ingest_documents.run(spark, f"{sf_dir}/documents.parque[t]", f"{at}/out", f"{at}/checkpoint", TEST_KEY, conf)
    return found.select("doc_id", "version", "digest", "policy", "source", "n_words", F.array_join("vec", ",").alias("vec"), "mac", "batch", "lang")


def job2_audit_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, conf = new_folder(spark, "job2"), _config("audit_answers")
    for _ in range(2):
        found = audit_answers.run(spark, f"{sf_dir}/conversations.parquet", at, TEST_KEY, conf)
    return found.select("conv_id", "turn", F.round("fraction", 6).alias("fraction"), "n_spans", "n_chars", "text", "outcome")


_POLICY = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _config("ingest_documents")["policies"].items()) + " END"
_META = " || ".join(PART(c) for pair in (("'digest'", "digest"), ("'lang'", "lang"), ("'source'", "source")) for c in pair)
_MESSAGE = " || ".join(map(PART, ("doc_id::VARCHAR", "('L' || vec)", "policy", f"({_META})", "'1'")))

QUERIES = {f.__name__: f for f in (job1_ingest_documents, job2_audit_answers)}
ORACLES = {
    "job1_ingest_documents": f"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents),
b AS (SELECT doc_id, ('0x' || substr(md5(word), 31, 2))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS n FROM w WHERE word <> '' GROUP BY ALL),
z AS (SELECT doc_id, sqrt(sum(n * n)) AS z, sum(n)::BIGINT AS n_words FROM b GROUP BY 1),
x AS (SELECT doc_id, i, max(n) FILTER (bucket = i) AS n FROM documents CROSS JOIN range(64) r(i) LEFT JOIN b USING (doc_id) GROUP BY ALL),
y AS (SELECT doc_id, string_agg(round_even(coalesce(n / z, 0) * 100, 0)::BIGINT::VARCHAR, ',' ORDER BY i) AS vec FROM x LEFT JOIN z USING (doc_id) GROUP BY 1),
d AS (SELECT doc_id, 1::BIGINT AS version, sha256(text) AS digest, {_POLICY} AS policy, source, coalesce(n_words, 0) AS n_words, vec, nullif(lang, '') AS lang
  FROM documents LEFT JOIN z USING (doc_id) LEFT JOIN y USING (doc_id) WHERE text IS NOT NULL AND doc_id IS NOT NULL)
SELECT doc_id, version, digest, policy, source, n_words, vec, {HMAC(_MESSAGE)} AS mac, 0::BIGINT AS batch, lang FROM d""",
    "job2_audit_answers": f"""WITH p AS ({PLACED}),
s AS (SELECT id, avg(grounded::INT) AS f, count(*) FILTER (NOT grounded) AS n, coalesce(sum(length(sentence)) FILTER (NOT grounded), 0) AS k,
  string_agg(CASE WHEN grounded THEN sentence ELSE repeat('█', length(sentence)) END || substr(c.text, (start + length(sentence) + 1)::BIGINT, gap), '' ORDER BY pos) AS body
  FROM p JOIN conversations c ON c.conv_id * 1000 + c.turn = id GROUP BY id),
a AS (SELECT conv_id, turn, text, coalesce(f, 1) AS f, coalesce(n, 0) AS n, coalesce(k, 0) AS k, body FROM conversations LEFT JOIN s ON id = conv_id * 1000 + turn WHERE role = 'assistant'),
o AS (SELECT *, CASE WHEN n = 0 THEN 'clean' WHEN n > 64 THEN 'span_cap' WHEN k > 1024 THEN 'char_cap' ELSE 'redacted' END AS outcome FROM a)
SELECT conv_id, turn, round(f, 6) AS fraction, n::INT AS n_spans, k::BIGINT AS n_chars, outcome, CASE WHEN outcome = 'redacted'
  THEN substr(text, 1, length(text) - length(regexp_replace(text, '^\\s+', ''))) || body || regexp_extract(text, '\\s*$') ELSE coalesce(text, '') END AS text FROM o""",
}
