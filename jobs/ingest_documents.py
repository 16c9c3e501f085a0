"""Keep a sealed, access-controlled index of a growing folder of documents up to date.

    python -m jobs.ingest_documents --docs PATH --out PATH --checkpoint PATH --key PATH [--config PATH] [--compact-to PATH]

Input: Parquet files with doc_id, text, lang and source (other columns are ignored). A file stream with a checkpoint
takes each file once; a document that comes again with another text is a new version, with the same text nothing, and
with a null text is withdrawn. Of several rows of a document in one batch that of the newest file counts (then the
larger digest, then the place in the file). Rows without doc_id are counted and left out; an empty lang counts as null.

Output, below --out, each batch in a folder of its own, which a batch that is tried again writes anew:
  index/batch=N/lang=L   doc_id, version, digest, policy, source, n_words, vec (quantised), mac
  ledger/batch=N         doc_id, version, digest, action: what `current` goes by; written last
  report/batch=N         rows read and documents by action
Only new and changed texts are embedded and sealed, and what was written is read back and checked against its MACs.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, log_to_stderr, read_config
from sealedspark import integrity, policy, vectors
from sealedspark.layout import broadcast_if_few, pin

DEFAULTS = {
    "dim": 64,
    "quant_bits": 2,
    "files_per_batch": 1000,
    # policy of a document by its language; one whose language is not listed is stored, and denied to all
    "policies": {},
}
INDEX = "doc_id bigint, version bigint, digest string, policy string, source string, n_words bigint, vec array<bigint>, mac string, batch bigint, lang string"
LEDGER = "doc_id bigint, version bigint, digest string, action string, batch bigint"
# At most so many rows that a batch leaves out are broadcast, so that texts are not shuffled; more are joined by shuffle.
FEW = 200_000


def _read(spark: SparkSession, path: str, schema: str, upto: int | None = None) -> DataFrame:
    """A table of batches; an empty one before the first. `upto` leaves that batch and later ones out."""
    try:
        found = spark.read.schema(schema).option("basePath", path).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return found if upto is None else found.where(F.col("batch") < upto)


def newest(ledger: DataFrame) -> DataFrame:
    """doc_id, version, digest, action, batch of the last entry of each document."""
    last = F.max_by(F.struct("version", "digest", "action", "batch"), "version")
    return ledger.groupBy("doc_id").agg(last.alias("x")).select("doc_id", "x.*")


def current(spark: SparkSession, out: str) -> DataFrame:
    """The documents that the index holds now, each in its newest version: what the ledger says, from the index."""
    held = newest(_read(spark, f"{out}/ledger", LEDGER)).where("action <> 'withdrawn'").select("doc_id", "version", "batch")
    return _read(spark, f"{out}/index", INDEX).join(held, ["doc_id", "version", "batch"])


def compact(spark: SparkSession, out: str, to: str) -> None:
    """Write what counts of an index to a new one at `to`, as one batch under the number of the last: later runs go on
    there with the same checkpoint. The old one is not touched; a compaction that dies is begun again at another path."""
    entries = newest(_read(spark, f"{out}/ledger", LEDGER))
    number = entries.agg(F.max("batch")).first()[0]
    if number is None:
        raise ValueError(f"{out}: no index")
    current(spark, out).drop("batch").write.mode("error").partitionBy("lang").parquet(f"{to}/index/batch={number}")
    entries.drop("batch").write.mode("error").parquet(f"{to}/ledger/batch={number}")
    log.info("compacted %s up to batch %d: read its index and ledger, wrote %s", out, number, to)


def _sealed_columns() -> dict[str, Column]:
    """What a MAC covers beside doc_id and version: the vector, its policy, and language, source and digest."""
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("digest"), F.col("digest"))
    return {"ct": F.col("vec"), "tag": F.col("policy"), "meta": meta}


def _actions(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """key, doc_id, version, digest, action of the row that counts of every document of a batch."""
    order = F.struct("changed_at", F.coalesce("digest", F.lit("")), "key")
    best = rows.groupBy("doc_id").agg(F.max_by(F.struct("key", "digest"), order).alias("x")).select("doc_id", "x.*")
    old = newest(ledger).select("doc_id", F.col("version").alias("before"), F.col("digest").alias("was"), (F.col("action") != "withdrawn").alias("here"))
    both = best.join(old, "doc_id", "left").withColumn("here", F.coalesce("here", F.lit(False)))
    action = (
        F.when(F.col("digest").isNull(), F.when(F.col("here"), "withdrawn").otherwise("unknown"))
        .when(F.col("here"), F.when(F.col("digest") == F.col("was"), "same").otherwise("changed"))
        .otherwise("new")
    )
    return both.select("key", "doc_id", (F.coalesce("before", F.lit(0)) + 1).cast("long").alias("version"), "digest", action.alias("action"))


def _policies(rules: dict) -> Column:
    if not rules:
        return F.lit(None).cast("string")
    for text in rules.values():
        policy.parse(text)  # a policy that cannot be read stops the job before it writes
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in sorted(rules.items()) for x in pair)), F.col("lang"))


def run(spark: SparkSession, docs: str, out: str, checkpoint: str, key: bytes, config: dict | None = None) -> DataFrame:
    """Take in what is new in `docs`, wait for it, and return the index as it stands (`current`)."""
    conf = DEFAULTS | (config or {})
    policy_of = _policies(conf["policies"])

    def batch_in(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        at = F.struct(F.col("path"), F.col("row_index"))
        rows = batch.withColumn("key", at).withColumn("digest", F.sha2("text", 256))
        narrow = pin(rows.select("key", "doc_id", "digest", "changed_at"))
        ledger = _read(session, f"{out}/ledger", LEDGER, number)
        done = pin(_actions(narrow.where("doc_id IS NOT NULL"), ledger))
        todo = done.where("action IN ('new', 'changed')").select("key", "version")
        # rows that need no work are few in the usual batch: to take these out moves no texts
        skip = broadcast_if_few(narrow.select("key").join(todo, "key", "left_anti"), FEW)
        fresh = rows.join(skip, "key", "left_anti")
        vec = vectors.quantize(F.col("vec"), conf["quant_bits"])
        words = F.size(F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda w: w != "")).cast("long")
        side = fresh.select("doc_id", "lang", "source", "digest", policy_of.alias("policy"), words.alias("n_words"))
        full = vectors.hash_vectors(fresh, conf["dim"]).select("doc_id", vec.alias("vec")).join(side, "doc_id").join(done.select("doc_id", "version"), "doc_id")
        sealed = full.withColumns(_sealed_columns())
        index = integrity.seal(sealed, key).select("doc_id", "version", "digest", "policy", "source", "n_words", "vec", "mac", "lang")
        index.write.mode("overwrite").partitionBy("lang").parquet(f"{out}/index/batch={number}")
        _verify(session, out, number, done, key)
        entries = done.where("action IN ('new', 'changed', 'withdrawn')").select("doc_id", "version", "digest", "action")
        entries.write.mode("overwrite").parquet(f"{out}/ledger/batch={number}")
        counts = done.groupBy("action").agg(F.count("*").alias("n"))
        total = narrow.agg(F.count("*").alias("n"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nameless"))
        found = {r.action: r.n for r in counts.collect()} | {"rows": (t := total.first()).n, "without doc_id": t.nameless}
        session.createDataFrame(sorted(found.items()), "what string, n long").coalesce(1).write.mode("overwrite").json(f"{out}/report/batch={number}")
        log.info("batch %d of %s: read %d rows; %s", number, docs, found["rows"], ", ".join(f"{k} {v}" for k, v in sorted(found.items()) if k != "rows"))
        log.info("batch %d: wrote %s and %s", number, f"{out}/index/batch={number}", f"{out}/ledger/batch={number}")

    schema = spark.read.parquet(docs).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", conf["files_per_batch"]).parquet(docs)
    taken = stream.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.nullif("lang", F.lit("")).alias("lang"), "source",
                          F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_index"), F.col("_metadata.file_modification_time").alias("changed_at"))
    query = taken.writeStream.foreachBatch(batch_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: all that is new in %s is in", out, docs)
    return current(spark, out)


def _verify(spark: SparkSession, out: str, number: int, done: DataFrame, key: bytes) -> None:
    """Read a batch's folder back: every document that was to be written is there, in its version, with a right MAC."""
    back = _read(spark, f"{out}/index", INDEX).where(F.col("batch") == number)
    want = done.where("action IN ('new', 'changed')").select("doc_id", "version")
    bad = integrity.verify(back.withColumns(_sealed_columns()), want, key)
    if wrong := bad.limit(5).collect():
        raise RuntimeError(f"batch {number} was not written as it should be: {[(r.doc_id, r.reason) for r in wrong]}")


def main(args: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="ingest_documents", description="Keep a sealed index of a growing folder up to date")
    for name in ("docs", "out", "checkpoint", "key"):
        ap.add_argument(f"--{name}", required=True)
    ap.add_argument("--config")
    ap.add_argument("--compact-to", help="then write the index as one batch to this new path, for --out of later runs")
    a = ap.parse_args(args)
    log_to_stderr()
    spark = SparkSession.builder.appName("ingest_documents").getOrCreate()
    try:
        config = read_config(spark, a.config, DEFAULTS) if a.config else None
        key = bytes.fromhex(spark.read.text(a.key).first().value.strip())  # 64 hexadecimal digits
        n = run(spark, a.docs, a.out, a.checkpoint, key, config).count()
        log.info("%s holds %d documents", a.out, n)
        if a.compact_to:
            compact(spark, a.out, a.compact_to)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
