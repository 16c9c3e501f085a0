"""Queries over sealed retrieval, grounding, integrity, privacy, inference and proofs, and their SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Window
from pyspark.sql import functions as F

from sealedspark import grounding, inference, ipfe, policy, privacy, proofs, retrieval, vectors
from sealedspark.catalog_tables import POLICIES, read, requests, vector_docs
from sealedspark.layout import spread

LEVELS = ["click", "purchase", "view"]


@lru_cache(maxsize=1)
def _scheme() -> ipfe.Scheme:
    return ipfe.Scheme.setup(64)


def _sealed(spark, sf_dir):
    docs = spread(vector_docs(spark, sf_dir)).select("doc_id", "policy", ipfe.encrypt(_scheme().public, vectors.quantize(F.col("vec"), 2)).alias("ct"))
    return docs, requests(spark, sf_dir).select("query_id", "attrs", vectors.quantize(F.col("vec"), 2).alias("q"))


def sealed_topk(spark, sf_dir):
    """Authorised top-5 over encrypted vectors: the gate is joined before the Arrow scoring."""
    return retrieval.rank_sealed(_scheme(), *_sealed(spark, sf_dir), POLICIES, 5)


def sealed_scores(spark, sf_dir):
    """Every document that a request may read, with its raw integer score and the cosine that it stands for."""
    s = retrieval.sealed_pairs(_scheme(), *_sealed(spark, sf_dir), POLICIES)
    return s.withColumn("cosine", F.round(retrieval.as_cosine(F.col("score"), 2), 6))


def _responses(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")).withColumnRenamed("conv_id", "scope")
    return c.where("role = 'assistant'").select("id", "scope", "text"), c.where("role <> 'assistant'").select("scope", "text")


def sentences(spark, sf_dir):
    return grounding.sentences(_responses(spark, sf_dir)[0]).select("id", "pos", "start", "end", "sentence")


def grounded_sentences(spark, sf_dir):
    return grounding.ground(*_responses(spark, sf_dir))


def grounded_fraction(spark, sf_dir):
    r, c = _responses(spark, sf_dir)
    return grounding.fraction(r, grounding.ground(r, c)).select("id", F.round("fraction", 6).alias("fraction"))


def ungrounded_spans(spark, sf_dir):
    return grounded_sentences(spark, sf_dir).where("NOT grounded").select("id", "start", "end")


def _reports(spark, sf_dir):
    r, c = _responses(spark, sf_dir)
    return r.join(grounding.report(r, grounding.ground(r, c)), "id")


def resolved_spans(spark, sf_dir):
    found = _reports(spark, sf_dir).select("id", grounding.resolve_spans(F.col("text"), F.col("spans")).alias("r"))
    return found.select("id", F.posexplode("r.spans").alias("pos", "s")).select("id", "pos", "s.start", "s.end")


def redacted_text(spark, sf_dir):
    """Responses with a block for each character of their ungrounded sentences."""
    found = _reports(spark, sf_dir).select("id", "text", grounding.resolve_spans(F.col("text"), F.col("spans"))["spans"].alias("at"))
    return found.select("id", grounding.redact(F.col("text"), F.col("at")).alias("redacted"))


def redaction_pass(spark, sf_dir):
    """Every turn of a conversation is a pass over one message; the spans are its first 4 and characters 10-600."""
    c = read(spark, sf_dir, "conversations")
    n = F.length("text").cast("long")
    span = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    spans = F.array(span(F.least(n, F.lit(10)), F.least(n, F.lit(600) + F.col("turn") * 200)), span(F.lit(0), F.least(n, F.lit(4))))
    return grounding.redaction_pass(c.select((F.col("conv_id") % 50).alias("message_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("arrival"), "text", spans.alias("spans")))


def redaction_audit(spark, sf_dir):
    return grounding.audit(redaction_pass(spark, sf_dir))


def _evidence(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumnRenamed("user_id", "subject")
    nth = F.row_number().over(Window.partitionBy("subject").orderBy("ts", "event_id"))
    return e.select("subject", nth.alias("round"), F.when(F.col("event_type").isin(LEVELS), F.col("event_type")).alias("reply"))


def posterior_by_round(spark, sf_dir):
    p = inference.posterior(_evidence(spark, sf_dir), LEVELS, {"view": 3.0})
    return p.select("subject", "round", "level", F.round("posterior", 6).alias("posterior"))


def rounds_until_grant(spark, sf_dir):
    first = _evidence(spark, sf_dir).where("round <= 20")  # no later round counts, nor does it change an earlier one
    return inference.rounds_until(inference.posterior(first, LEVELS, q=0.4), "purchase", 0.6, 20)


def belief_top(spark, sf_dir):
    """The likeliest level of each user after every reply, and whether it is granted."""
    p = inference.top(inference.posterior(_evidence(spark, sf_dir), LEVELS, {"view": 3.0}))
    return p.select("subject", "round", "level", F.round("posterior", 6).alias("posterior"), "granted")


def dp_order_sums(spark, sf_dir):
    u = lambda c, i: (F.conv(F.substring(F.md5(F.concat(c, F.lit(str(i)))), 1, 6), 16, 10).cast("double") + 0.5) / 16777216.0
    out = privacy.noisy_sums(read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 0.0, 100000.0, 1.0, u)
    return out.select("o_orderpriority", *(F.round(c, 2).alias(c) for c in ("noisy_n", "noisy_sum", "noisy_avg")))


def dp_rollup(spark, sf_dir):
    """Noisy order figures over all, by priority and by priority and status, where every group is the sum of its parts."""
    u = lambda c, i: (F.conv(F.substring(F.md5(F.concat(c, F.lit(str(i))).cast("binary")), 1, 6), 16, 10).cast("double") + 0.5) / 16777216.0
    out = privacy.noisy_rollup(read(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice", 0.0, 100000.0, 3.0, u)
    return out.select("level", "o_orderpriority", "o_orderstatus", *(F.round(c, 2).alias(c) for c in ("noisy_n", "noisy_sum")))


def adaptive_eps(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(privacy.adaptive_eps(F.length("text"), 0.1, 1.0, 0.5, 4096), 12).alias("eps"))


def _claims(spark, sf_dir):
    """Every document proves its language and its source for itself; some proofs are damaged by doc_id."""
    p, g = proofs.group()
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"))
    attrs = F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"))
    each = d.select("doc_id", F.posexplode(attrs).alias("nth", "attr")).where("attr IS NOT NULL")
    context = F.concat(F.lit("document "), F.col("doc_id").cast("string"))
    made_for = F.when(F.col("doc_id") % 11 == 3, F.concat(context, F.lit("0"))).otherwise(context)
    each = each.withColumn("p", proofs.proof(p, g, F.col("attr"), made_for)).select("doc_id", "nth", "attr", context.alias("context"), "p.*")
    hit = (F.col("doc_id") % 7 == 2) & (F.col("nth") == 1)
    last = F.length("s")
    other = F.concat(F.substring("s", 1, last - 1), F.translate(F.substring("s", last, F.lit(1)), "0123456789", "1234567890"))
    each = each.withColumn("s", F.when(hit, other).otherwise(F.col("s")))
    each = each.withColumn("c", F.when(F.col("doc_id") % 13 == 4, F.lit("1")).otherwise(F.col("c")))
    each = each.withColumn("t", F.when(F.col("doc_id") % 17 == 5, None).when(F.col("doc_id") % 19 == 6, F.concat(F.lit("-"), "t")).otherwise(F.col("t")))
    ok = proofs.verify(p, g, F.col("attr"), F.col("context"), F.col("t"), F.col("c"), F.col("s"))
    return each.select("doc_id", "attr", ok.alias("ok"))


def proof_checks(spark, sf_dir):
    """The proofs of all documents' attributes, checked in batches."""
    return _claims(spark, sf_dir)


def attributes_proved(spark, sf_dir):
    """Whether each document has proved all that it claims."""
    d = read(spark, sf_dir, "documents")
    attrs = F.array_compact(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source")))
    done = proofs.all_proved(d.select(F.col("doc_id").alias("caller_id"), attrs.alias("attrs")), _claims(spark, sf_dir).withColumnRenamed("doc_id", "caller_id"))
    return done.withColumnRenamed("caller_id", "doc_id")


def caller_parse(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Lang: "), "lang", F.lit(" , SOURCE:"), "source", F.lit(",Guest")).alias("s"))
    return d.select("doc_id", F.array_join(policy.parse_caller(F.col("s")), "|").alias("attrs"))


def excerpt(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", grounding.excerpt(F.col("text")).alias("excerpt"))


_TOK = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z0-9'']+')), lambda t: NOT list_contains({}, t))"
_STOP = """string_split('a an the and or but of to in on for with at by from as it its is are was were be been being this that these those not
 no i you he she we they do does did will would can could should have has had there then than so about into over under after before between up out', ' ')""".replace("\n", "")
_SENT = r"""SELECT id, scope, pos, coalesce(sum(length(sentence) + 1) OVER w, 0)::BIGINT AS start,
 coalesce(sum(length(sentence) + 1) OVER w, 0)::BIGINT + length(sentence) AS "end", sentence FROM (
 SELECT conv_id * 1000 + turn AS id, conv_id AS scope, (unnest(generate_series(1, len(a))) - 1)::INT AS pos, unnest(a) AS sentence FROM (
  SELECT *, string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS a
  FROM conversations WHERE role = 'assistant')) WHERE sentence <> '' WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_GROUND = f"""SELECT id, pos, start, "end", sentence, EXISTS (FROM conversations c WHERE c.conv_id = s.scope AND c.role <> 'assistant'
 AND list_has_any({_TOK.format('c.text', _STOP)}, {_TOK.format('s.sentence', _STOP)})) AS grounded FROM ({_SENT}) s"""
_LIK = "CASE WHEN reply IS NULL THEN 1/3.0::DOUBLE WHEN reply = level THEN {q} * 0.95::DOUBLE + (1 - {q}) / 3 ELSE {q} * (1 - 0.95::DOUBLE) / 2 + (1 - {q}) / 3 END"
_POST = """WITH e AS (SELECT user_id AS subject, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS round,
 CASE WHEN event_type IN ('click', 'purchase', 'view') THEN event_type END AS reply FROM events),
x AS (SELECT subject, round, level, sum(ln({lik})) OVER (PARTITION BY subject, level ORDER BY round) + ln(prior) AS s
 FROM e, (VALUES {prior}) v(level, prior)),
y AS (SELECT *, exp(s - max(s) OVER (PARTITION BY subject, round)) AS z FROM x),
p AS (SELECT subject, round, level, z / sum(z) OVER (PARTITION BY subject, round) AS posterior FROM y) """

QUERIES = {f.__name__: f for f in (
    sealed_topk, sealed_scores, sentences, grounded_sentences, grounded_fraction, ungrounded_spans, resolved_spans, redacted_text, redaction_pass,
    redaction_audit, posterior_by_round, belief_top, rounds_until_grant, dp_order_sums, dp_rollup, adaptive_eps, proof_checks, attributes_proved, caller_parse, excerpt)}
PLACED = f"""SELECT g.id, g.pos, g.grounded, lead_ws + coalesce(sum(length(g.sentence) + gap) OVER w, 0) AS start, g.sentence, gap FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS nth FROM ({_GROUND})) g
JOIN (SELECT conv_id * 1000 + turn AS id, length(text) - length(regexp_replace(text, '^\\s+', '')) AS lead_ws,
  list_transform(regexp_extract_all(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '[.!?]\\s+'), lambda x: length(x) - 1) AS gaps FROM conversations WHERE role = 'assistant') t USING (id)
CROSS JOIN LATERAL (SELECT coalesce(gaps[g.nth], 0) AS gap) WINDOW w AS (PARTITION BY g.id ORDER BY g.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_PASS = """WITH m AS (SELECT conv_id % 50 AS message_id, conv_id * 1000 + turn AS arrival, text, length(text)::BIGINT AS n, least(length(text), 600 + turn * 200) AS e FROM conversations),
a AS (SELECT *, (e - least(n, 10)) + least(n, 4) AS k FROM m),
b AS (SELECT *, CASE WHEN k > 1024 THEN 'char_cap' END AS refused FROM a),
c AS (SELECT *, CASE WHEN coalesce(bool_or(refused IS NULL) OVER (PARTITION BY message_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'already_done' ELSE refused END AS reason FROM b)
"""
_PROVED = """SELECT doc_id, attr, NOT (doc_id % 11 = 3 OR doc_id % 7 = 2 AND nth = 1 OR doc_id % 13 = 4 OR doc_id % 17 = 5 OR doc_id % 19 = 6) AS ok FROM (
 SELECT doc_id, 0 AS nth, 'lang:' || lang AS attr FROM documents UNION ALL SELECT doc_id, 1, 'source:' || source FROM documents) WHERE attr IS NOT NULL"""
ORACLES = {
    "sentences": f'SELECT id, pos, start, "end", sentence FROM ({_SENT})',
    "grounded_sentences": _GROUND,
    "grounded_fraction": f"""SELECT r.id, round(coalesce(f, 1.0), 6) AS fraction FROM (SELECT conv_id * 1000 + turn AS id FROM conversations WHERE role = 'assistant') r
 LEFT JOIN (SELECT id, avg(grounded::INT) AS f FROM ({_GROUND}) GROUP BY id) g ON g.id = r.id""",
    "ungrounded_spans": f'SELECT id, start, "end" FROM ({_GROUND}) WHERE NOT grounded',
    "resolved_spans": f'SELECT id, (row_number() OVER (PARTITION BY id ORDER BY pos) - 1)::INT AS pos, start::BIGINT AS start, (start + length(sentence))::BIGINT AS "end" FROM ({PLACED}) WHERE NOT grounded',
    "redacted_text": f"""SELECT r.conv_id * 1000 + r.turn AS id, coalesce(substr(r.text, 1, length(r.text) - length(regexp_replace(r.text, '^\\s+', ''))) ||
 p.body || regexp_extract(r.text, '\\s*$'), r.text) AS redacted FROM conversations r LEFT JOIN (SELECT id, string_agg(CASE WHEN grounded THEN sentence ELSE repeat('█', length(sentence)) END
 || substr(orig, (start + length(sentence) + 1)::BIGINT, gap), '' ORDER BY pos) AS body FROM ({PLACED}) JOIN (SELECT conv_id * 1000 + turn AS id, text AS orig FROM conversations) USING (id) GROUP BY id) p
 ON p.id = r.conv_id * 1000 + r.turn WHERE r.role = 'assistant'""",
    "redaction_pass": _PASS + """SELECT message_id, arrival, 2 AS n_spans, k::BIGINT AS n_chars, reason IS NULL AS applied, reason,
 CASE WHEN reason IS NULL THEN repeat('█', least(n, 4)) || substr(text, 5, 6) || repeat('█', e - least(n, 10)) || substr(text, greatest(e, 10) + 1) ELSE text END AS redacted FROM c""",
    "redaction_audit": _PASS + "SELECT message_id, arrival AS ts, 2 AS n_spans, k::BIGINT AS n_chars, reason AS refused FROM c WHERE reason IS NULL OR reason <> 'already_done'",
    "posterior_by_round": _POST.format(lik=_LIK.format(q="0.8::DOUBLE"), prior="('click', 0.2::DOUBLE), ('purchase', 0.2), ('view', 0.6)") + "SELECT subject, round, level, round(posterior, 6) AS posterior FROM p",
    "belief_top": _POST.format(lik=_LIK.format(q="0.8::DOUBLE"), prior="('click', 0.2::DOUBLE), ('purchase', 0.2), ('view', 0.6)") + """, r AS (SELECT *, row_number() OVER (PARTITION BY subject, round
 ORDER BY round(posterior, 12) DESC, level) AS nth FROM p) SELECT subject, round, level, round(posterior, 6) AS posterior, round(posterior, 12) >= 0.6 AS granted FROM r WHERE nth = 1""",
    "rounds_until_grant": _POST.format(lik=_LIK.format(q="0.4::DOUBLE"), prior="('click', 1/3.0::DOUBLE), ('purchase', 1/3.0::DOUBLE), ('view', 1/3.0::DOUBLE)")
    + "SELECT subject, coalesce(min(round) FILTER (level = 'purchase' AND posterior >= 0.6 AND round <= 20), 21)::BIGINT AS rounds FROM p GROUP BY 1",
    "dp_order_sums": """WITH s AS (SELECT o_orderpriority, count(*) AS n, sum(greatest(least(o_totalprice, 100000), 0)) AS t FROM orders GROUP BY 1),
u AS (SELECT *, list_transform(['0', '1'], lambda i: (('0x' || substr(md5(o_orderpriority || i), 1, 6))::BIGINT + 0.5::DOUBLE) / 16777216) AS u FROM s),
l AS (SELECT *, list_transform(u, lambda x: CASE WHEN x >= 0.5 THEN -2 * ln(2 * (1 - x)) ELSE 2 * ln(2 * x) END) AS l FROM u),
r AS (SELECT o_orderpriority, n + l[1] AS noisy_n, t + 100000 * l[2] AS noisy_sum FROM l)
SELECT o_orderpriority, round(noisy_n, 2) AS noisy_n, round(noisy_sum, 2) AS noisy_sum, round(noisy_sum / greatest(noisy_n, 1), 2) AS noisy_avg FROM r""",
    # constrained least squares over two levels of children, written out: k children of variance 1 below a node
    "dp_rollup": """WITH s AS (SELECT o_orderpriority AS p, o_orderstatus AS o, count(*) AS n, sum(greatest(least(o_totalprice, 100000), 0)) AS t FROM orders GROUP BY 1, 2),
g AS (SELECT 0 AS l, NULL AS p, NULL AS o, sum(n) AS n, sum(t) AS t, '[]' AS path FROM s UNION ALL SELECT 1, p, NULL, sum(n), sum(t), '["' || p || '"]' FROM s GROUP BY p
  UNION ALL SELECT 2, p, o, n, t, '["' || p || '","' || o || '"]' FROM s),
m AS (SELECT l, p, o, unnest([0, 1]) AS k, unnest([n::DOUBLE, t]) AS x, unnest([1.0::DOUBLE, 100000.0]) AS sens, path FROM g),
u AS (SELECT *, (('0x' || substr(md5(path || k), 1, 6))::BIGINT + 0.5::DOUBLE) / 16777216 AS u FROM m),
y AS (SELECT l, p, o, k, x + sens / 0.5::DOUBLE * CASE WHEN u >= 0.5 THEN -ln(2 * (1 - u)) ELSE ln(2 * u) END AS y FROM u),
b AS (SELECT p, k, sum(y) AS kz, count(*) AS c FROM y WHERE l = 2 GROUP BY 1, 2),
z1 AS (SELECT p, k, c / (c + 1) AS v, c / (c + 1) * y + kz / (c + 1) AS z, kz, c FROM y JOIN b USING (p, k) WHERE l = 1),
r AS (SELECT k, sum(z) AS kz, sum(v) AS kv FROM z1 GROUP BY 1),
h0 AS (SELECT k, kv / (kv + 1) * y + kz / (kv + 1) AS h, kz, kv FROM y JOIN r USING (k) WHERE l = 0),
h1 AS (SELECT p, k, z + (h0.h - h0.kz) * v / h0.kv AS h, z1.kz, c FROM z1 JOIN h0 USING (k)),
h2 AS (SELECT p, o, k, y + (h - kz) / c AS h FROM y JOIN h1 USING (p, k) WHERE l = 2),
a AS (SELECT 0 AS level, NULL AS p, NULL AS o, k, h FROM h0 UNION ALL SELECT 1, p, NULL, k, h FROM h1 UNION ALL SELECT 2, p, o, k, h FROM h2)
SELECT level, p AS o_orderpriority, o AS o_orderstatus, round(max(h) FILTER (k = 0), 2) AS noisy_n, round(max(h) FILTER (k = 1), 2) AS noisy_sum FROM a GROUP BY ALL""",
    "adaptive_eps": "SELECT doc_id, round(CASE WHEN coalesce(length(text), 0) > 0 THEN 0.1::DOUBLE + 0.9::DOUBLE * least(1.0::DOUBLE, length(text) / 4096.0::DOUBLE) ELSE 0.5 END, 12) AS eps FROM documents",
    "proof_checks": _PROVED,
    "attributes_proved": f"SELECT doc_id, coalesce(bool_and(ok), true) AS proved FROM documents LEFT JOIN ({_PROVED}) USING (doc_id) GROUP BY 1",
    "caller_parse": "SELECT doc_id, 'lang:' || lower(lang) || '|source:' || lower(source) || '|guest' AS attrs FROM documents",
    "excerpt": r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '...' ELSE t END AS excerpt FROM t""",
}
