"""Queries over sealed, stored and tampered documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealedspark import integrity, store
from sealedspark.catalog_tables import read

TEST_KEY = bytes(range(32))


def _store(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    meta = F.create_map(F.lit("lang"), "lang", F.lit("chars"), F.col("n_chars").cast("string"))
    return d.select("doc_id", F.md5("text").alias("ct"), F.col("source").alias("tag"), meta.alias("meta"), F.lit(1).cast("long").alias("version"))


def _tampered(spark, sf_dir):
    """The sealed store with each kind of damage, rows that were put in without the key, and its manifest."""
    s = integrity.seal(_store(spark, sf_dir), TEST_KEY)
    manifest = s.select("doc_id", F.when(F.col("doc_id") % 29 == 6, 2).otherwise(1).cast("long").alias("version"))
    bad = s.where("doc_id % 23 <> 5").withColumn("ct", F.expr("CASE WHEN doc_id % 13 = 2 THEN NULL WHEN doc_id % 17 = 3 THEN concat(ct, 'x') ELSE ct END"))
    bad = bad.withColumn("mac", F.expr("CASE WHEN doc_id % 19 = 4 THEN NULL ELSE mac END"))
    bad = bad.withColumn("meta", F.expr("CASE WHEN doc_id % 31 = 7 THEN map_concat(map_filter(meta, (k, v) -> k <> 'lang'), map('lang', 'xx')) ELSE meta END"))
    bad = bad.withColumn("tag", F.expr("CASE WHEN doc_id % 37 = 8 THEN NULL ELSE tag END")).withColumn("version", F.expr("CASE WHEN doc_id % 41 = 9 THEN 7L ELSE version END"))
    put_in = s.where("doc_id % 43 = 10").withColumn("doc_id", F.col("doc_id") + 10_000_000_000)
    put_in = put_in.withColumn("mac", F.when(F.col("doc_id") % 2 == 0, F.sha2(F.col("ct"), 256)))
    return bad.unionByName(put_in), manifest


def _damaged(spark, sf_dir):
    """The ids of all that `_tampered` has damaged, as it was done: what a perfect detector would report."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    hit = " OR ".join(f"doc_id % {n} = {r}" for n, r in ((23, 5), (13, 2), (17, 3), (19, 4), (31, 7), (37, 8), (41, 9), (29, 6)))
    return d.where(hit).union(d.where("doc_id % 43 = 10").select(F.col("doc_id") + 10_000_000_000))


def detection_rates(spark, sf_dir):
    """The share of damaged documents that a store without a key notices (absent or unreadable ones), and with MACs."""
    found = integrity.verify(*_tampered(spark, sf_dir), TEST_KEY)
    both = _damaged(spark, sf_dir).join(found, "doc_id", "left")
    plain = F.col("reason").isin("doc_missing", "store_unreadable")
    return both.agg(F.avg(F.coalesce(plain, F.lit(False)).cast("double")).alias("baseline"), F.avg(F.col("reason").isNotNull().cast("double")).alias("improved"))


def mac_tags(spark, sf_dir):
    return integrity.seal(_store(spark, sf_dir), TEST_KEY, integrity.mac_sql).select("doc_id", "mac")


def tamper_report(spark, sf_dir):
    return integrity.verify(*_tampered(spark, sf_dir), TEST_KEY)


def incident_log(spark, sf_dir):
    log = integrity.incidents(integrity.verify(*_tampered(spark, sf_dir), TEST_KEY))
    return log.groupBy("reason", "note").agg(F.count("*").alias("n"), F.count("ts").alias("dated"))


def verified_ids(spark, sf_dir):
    return integrity.verified(_tampered(spark, sf_dir)[0], TEST_KEY).select("doc_id")


def missing_docs(spark, sf_dir):
    bad, manifest = _tampered(spark, sf_dir)
    return integrity.missing(manifest, bad)


def injected_docs(spark, sf_dir):
    """Rows that no manifest names, and why they do not count."""
    bad, manifest = _tampered(spark, sf_dir)
    return integrity.stale(bad, manifest).select("doc_id").join(tamper_report(spark, sf_dir), "doc_id")


def grown_manifest(spark, sf_dir):
    bad, manifest = _tampered(spark, sf_dir)
    return integrity.registered(manifest, bad.where("doc_id < 10000000000"))


def stale_docs(spark, sf_dir):
    """Documents that a manifest without every third id no longer names."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("version"), "source")
    return integrity.stale(d, d.where("doc_id % 3 <> 1")).select("doc_id", "source")


def store_roundtrip(spark, sf_dir):
    """Documents encrypted and decrypted; every seventh chunk has been moved to another id and cannot be read."""
    d = read(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.col("text").cast("binary").alias("blob"), F.col("source").alias("tag"), F.create_map(F.lit("lang"), "lang").alias("meta"))
    moved = store.encrypt(chunks, TEST_KEY).withColumn("chunk_id", F.when(F.col("chunk_id") % 7 == 3, -F.col("chunk_id")).otherwise(F.col("chunk_id")))
    got = store.decrypt(moved, TEST_KEY)
    return got.select("chunk_id", F.md5("blob").alias("digest"), "tag", F.element_at("meta", "lang").alias("lang"), "reason")


def latest_per_user(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return integrity.latest(e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("version"), "event_type"))


_PAD = lambda b: "'" + "".join(f"\\x{b ^ x:02X}" for x in TEST_KEY + bytes(32)) + "'::BLOB"
PART = lambda c: f"coalesce('S' || length({c}) || ':' || {c}, 'N')"
HMAC = lambda message: f"sha256({_PAD(0x5C)} || unhex(sha256({_PAD(0x36)} || encode({message}))))"
_META = " || ".join(map(PART, ("'chars'", "n_chars::VARCHAR", "'lang'", "lang")))
_MSG = " || ".join(map(PART, ("doc_id::VARCHAR", "('T' || md5(text))", "source", f"({_META})", "'1'")))
_REASON = """CASE WHEN doc_id % 23 = 5 THEN 'doc_missing' WHEN doc_id % 13 = 2 THEN 'store_unreadable' WHEN doc_id % 19 = 4 THEN 'missing_mac'
 WHEN doc_id % 17 = 3 OR doc_id % 31 = 7 OR doc_id % 37 = 8 OR doc_id % 41 = 9 THEN 'mac_mismatch' WHEN doc_id % 29 = 6 THEN 'version_rollback' END"""
_PUT_IN = "SELECT doc_id + 10000000000 AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 'mac_mismatch' ELSE 'missing_mac' END AS reason FROM documents WHERE doc_id % 43 = 10"
DETECTED = f"""SELECT count(*) FILTER (reason IN ('doc_missing', 'store_unreadable')) / count(*) AS baseline, 1.0::DOUBLE AS improved
FROM (SELECT {_REASON} AS reason FROM documents UNION ALL SELECT reason FROM ({_PUT_IN})) WHERE reason IS NOT NULL"""
_TAMPERED = f"SELECT * FROM (SELECT doc_id, {_REASON} AS reason FROM documents UNION ALL {_PUT_IN}) WHERE reason IS NOT NULL"

QUERIES = {f.__name__: f for f in (
    detection_rates, mac_tags, tamper_report, incident_log, verified_ids, missing_docs, injected_docs, grown_manifest, stale_docs, store_roundtrip, latest_per_user)}
ORACLES = {
    "detection_rates": DETECTED,
    "mac_tags": f"SELECT doc_id, {HMAC(_MSG)} AS mac FROM documents",
    "tamper_report": _TAMPERED,
    "incident_log": "SELECT reason, " + "CASE reason " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in integrity.NOTES.items()) + f" END AS note, count(*) AS n, count(*) AS dated FROM ({_TAMPERED}) GROUP BY 1, 2",
    "verified_ids": f"SELECT doc_id FROM documents WHERE {_REASON} IS NULL OR ({_REASON}) = 'version_rollback'",
    "missing_docs": "SELECT doc_id FROM documents WHERE doc_id % 23 = 5",
    "injected_docs": _PUT_IN,
    "grown_manifest": "SELECT doc_id, CASE WHEN doc_id % 41 = 9 AND doc_id % 23 <> 5 THEN 7 WHEN doc_id % 29 = 6 THEN 2 ELSE 1 END::BIGINT AS version FROM documents",
    "stale_docs": "SELECT doc_id, source FROM documents WHERE doc_id % 3 = 1",
    "store_roundtrip": """SELECT CASE WHEN doc_id % 7 = 3 THEN -doc_id ELSE doc_id END AS chunk_id, CASE WHEN doc_id % 7 <> 3 THEN md5(text) END AS digest, CASE WHEN doc_id % 7 <> 3 THEN source END AS tag,
 CASE WHEN doc_id % 7 <> 3 THEN lang END AS lang, CASE WHEN doc_id % 7 = 3 THEN 'store_unreadable' END AS reason FROM documents""",
    "latest_per_user": "SELECT user_id AS doc_id, max(event_id) AS version, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1",
}
