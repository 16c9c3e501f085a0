"""Chunks encrypted at rest as Parquet: AES-GCM over blob, tag and meta, bound to the chunk's id.

The key enters plans as the column of a broadcast one-row table, never as a literal. A chunk that was written under
another key or moved to another id cannot be decrypted and reads as unreadable, not as an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealedspark.layout import broadcast_if_few, pin

PAYLOAD = "struct<blob:string,tag:string,meta:map<string,string>>"


def _with_key(df: DataFrame, key: bytes) -> DataFrame:
    if len(key) not in (16, 24, 32):
        raise ValueError("an AES key has 16, 24 or 32 bytes")
    return df.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(bytearray(key),)], "__key binary")))


def encrypt(chunks: DataFrame, key: bytes) -> DataFrame:
    """chunk_id, sealed of `chunks` (chunk_id, blob binary, tag, meta map)."""
    plain = F.to_json(F.struct(F.base64("blob").alias("blob"), "tag", "meta"))
    aad = F.col("chunk_id").cast("string").cast("binary")
    sealed = F.aes_encrypt(plain.cast("binary"), F.col("__key"), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), aad)
    return _with_key(chunks, key).select("chunk_id", sealed.alias("sealed"))


def decrypt(sealed: DataFrame, key: bytes) -> DataFrame:
    """chunk_id, blob, tag, meta, reason of `sealed` (chunk_id, sealed); reason is store_unreadable or null."""
    aad = F.col("chunk_id").cast("string").cast("binary")
    plain = F.try_aes_decrypt(F.col("sealed"), F.col("__key"), F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")
    opened = _with_key(sealed, key).select("chunk_id", F.from_json(plain, PAYLOAD).alias("p"))
    reason = F.when(F.col("p").isNull(), "store_unreadable")
    return opened.select("chunk_id", F.unbase64("p.blob").alias("blob"), "p.tag", "p.meta", reason.alias("reason"))


# A store is a folder: chunks/put=V/bucket=B holds sealed chunks, heads/put=V which ids that put wrote or deleted.
# A put writes its chunks and then, as its last step, its heads: what no head names is not there. So a put that dies
# leaves nothing that a reader sees, and the next one takes a number of its own.

# At most so many superseded (id, put) rows or heads are broadcast, so that sealed chunks are not shuffled.
FEW = 500_000
SPLIT = 4  # files of a bucket in one put, at most


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of puts, or None before the first."""
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _last_put(spark: SparkSession, path: str) -> int:
    """The largest number that any put has taken, finished or not."""
    found = [_table(spark, f"{path}/{part}") for part in ("chunks", "heads")]
    return max((t.agg(F.max("put")).first()[0] or 0 for t in found if t is not None), default=0)


def heads(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, put, buckets, deleted: the newest entry of every id. No sealed chunk is read."""
    held = _table(spark, f"{path}/heads")
    if held is None:
        raise FileNotFoundError(path)
    return held.groupBy("chunk_id").agg(F.max_by(F.struct("put", "buckets", "deleted"), "put").alias("x")).select("chunk_id", "x.*")


def bucket(buckets: Column) -> Column:
    """The bucket of a chunk_id among so many."""
    return F.pmod(F.xxhash64(F.col("chunk_id").cast("string")), buckets).cast("int")


def _commit(ids: DataFrame, deleted: bool, buckets: int, path: str, number: int) -> None:
    rows = ids.select("chunk_id", F.lit(deleted).alias("deleted"), F.lit(buckets).alias("buckets"))
    rows.write.mode("error").parquet(f"{path}/heads/put={number}")


def _write(sealed: DataFrame, path: str, number: int, buckets: int) -> None:
    """Chunks by bucket; each bucket of a put has a few files, dealt by id."""
    rows = sealed.withColumn("bucket", bucket(F.lit(buckets))).repartition("bucket", F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.lit(SPLIT)))
    rows.write.mode("error").partitionBy("bucket").parquet(f"{path}/chunks/put={number}")


def put(chunks: DataFrame, key: bytes, path: str, buckets: int = 16) -> int:
    """Add chunks to the store at a path that all executors share, and return the put's number; the newest put of an id
    counts. Ids that a put holds twice, or that are null, are an error, and so is a second writer that takes the same
    number: the store stays as it was then.
    """
    spark = chunks.sparkSession
    ids = pin(chunks.select("chunk_id"))
    if not ids.groupBy("chunk_id").count().where("count > 1 OR chunk_id IS NULL").isEmpty():
        raise ValueError("a put holds each chunk once, under an id")
    number = _last_put(spark, path) + 1
    _write(encrypt(chunks, key), path, number, buckets)
    _commit(ids, False, buckets, path, number)
    return number


def delete(ids: DataFrame, path: str) -> None:
    """Take ids (chunk_id) out of a store; those that it lacks are an error."""
    spark = ids.sparkSession
    if not ids.join(list_ids(spark, path), "chunk_id", "left_anti").isEmpty():
        raise KeyError("no such chunk")
    _commit(pin(ids.select("chunk_id").distinct()), True, 0, path, _last_put(spark, path) + 1)


def current(spark: SparkSession, path: str, ids: list | None = None) -> DataFrame:
    """chunk_id, sealed: the newest chunk of every id that is not deleted, or of some ids, of which only the buckets
    are read (by partition; a store whose puts differ in their number of buckets is pruned for each of these)."""
    newest = heads(spark, path)
    chunks = _table(spark, f"{path}/chunks")
    live = newest.where("NOT deleted")
    if chunks is None:
        return live.select("chunk_id", F.lit(None).cast("binary").alias("sealed")).limit(0)
    if ids is not None:
        wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], newest.select("chunk_id").schema).distinct())
        live = pin(live.join(wanted, "chunk_id"))
        at = live.select("put", bucket(F.col("buckets")).alias("bucket")).distinct().collect()  # as many as `ids`
        by_put: dict[int, set] = {}
        for r in at:
            by_put.setdefault(r.put, set()).add(r.bucket)
        here = reduce(lambda a, b: a | b, [(F.col("put") == p) & F.col("bucket").isin(sorted(bs)) for p, bs in sorted(by_put.items())], F.lit(False))
        return chunks.where(here).join(F.broadcast(live.select("chunk_id", "put")), ["chunk_id", "put"]).select("chunk_id", "sealed")
    # most chunks are current: the few that are not are taken out, by a broadcast where their number allows
    stale = chunks.select("chunk_id", "put").join(live.select("chunk_id", "put"), ["chunk_id", "put"], "left_anti")
    return chunks.join(broadcast_if_few(stale, FEW), ["chunk_id", "put"], "left_anti").select("chunk_id", "sealed")


def get(spark: SparkSession, key: bytes, path: str, ids: list | None = None) -> DataFrame:
    """chunk_id, blob, tag, meta, reason of all chunks of a store, or of those named by `ids`."""
    return decrypt(current(spark, path, ids), key)


def list_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids of a store; contents are not read."""
    return heads(spark, path).where("NOT deleted").select("chunk_id")


def compact(spark: SparkSession, path: str, to: str, buckets: int = 16) -> int:
    """Write what counts of a store to a new one at `to`, as one put without superseded chunks, tombstones and what
    failed puts left; returns its number, that of the last put, so that versions go on from there. The old store is
    not touched: readers change over to the new path, and a compaction that dies is begun again at another one.
    """
    number = _last_put(spark, path)
    rows = current(spark, path)
    _write(rows, to, number, buckets)
    _commit(list_ids(spark, path), False, buckets, to, number)
    return number


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows (audit lines, incidents) to a log of JSON lines."""
    rows.write.mode("append").json(path)
