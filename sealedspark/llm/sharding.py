"""Shards by extendible hashing.

The directory is indexed by the leading bits of a document's 64-bit hash. Every bucket starts at depth 0; a
bucket over its byte limit splits on its next bit, the others stay. The sizes come from one histogram of bytes
by the hash's first `grain` bits, made with partial aggregation; buckets that are still too large at that depth
are refined from their own rows alone, `grain` bits at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealedspark.llm.common import cut, drop, maybe_broadcast

# At most so many hashes are broadcast (8 bytes each); more are joined by shuffle.
MAX_HASHES = 1_000_000


def _bits(column: str, width: str | int, depth: str | int):
    """The leading `depth` bits of a number of `width` bits; SQL shifts by 64 do nothing, hence the case."""
    return F.expr(f"CASE WHEN {depth} = 0 THEN 0L ELSE shiftrightunsigned({column}, {width} - {depth}) END")


def shard(docs: DataFrame, limit: int = 128 << 20, grain: int = 12) -> DataFrame:
    """A shard for every row of `docs` (doc_id, text; other columns are ignored), of at most `limit` bytes each.

    Returns doc_id, n_bytes (UTF-8 bytes of text, 0 for null), depth, bucket (leading bits of the hash as 0s
    and 1s, empty at depth 0), shard_bytes, oversized. Only a shard of one row larger than the limit, or one of
    depth 64, whose rows have one and the same hash, is oversized. The hash covers doc_id and text; repeated rows
    differ by a row number taken once and written. Null and empty texts have 0 bytes.
    """
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    ident = F.col("doc_id").cast("long")
    h = F.xxhash64(ident, F.xxhash64("text"))
    rows = docs.select(ident.alias("doc_id"), bytes_.alias("n_bytes"), h.alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = cut(rows)
    # rows with one hash cannot be told apart by more of its bits: only those take their row number in
    same = cut(rows.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select(F.col("h").alias("h2")))
    mixed = F.when(F.col("h2").isNotNull(), F.xxhash64("h", "row")).otherwise(F.col("h"))
    keyed = cut(rows.join(maybe_broadcast(same, MAX_HASHES), F.col("h") == F.col("h2"), "left").select("doc_id", "n_bytes", mixed.alias("h")))
    drop(rows, same)
    todo, base, found = keyed, 0, []
    while base < 64:
        top = min(64, base + grain)
        hist = cut(todo.groupBy(_bits("h", 64, top).alias("p")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("k")))
        depths = []
        for d in range(base, top + 1):
            depths.append(hist.groupBy(_bits("p", top, d).alias("q")).agg(F.sum("b").alias("b"), F.sum("k").alias("k")).select(F.lit(d).alias("d"), "q", "b", "k"))
        fits = depths[0]
        for x in depths[1:]:
            fits = fits.unionByName(x)
        fits = fits.withColumn("ok", (F.col("b") <= limit) | (F.col("k") <= 1) | (F.col("d") == 64))
        # each histogram cell takes the shallowest depth at which its bucket fits
        cells = hist.select("p", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("d"))
        first = cells.withColumn("q", _bits("p", top, "d")).join(fits.where("ok"), ["d", "q"])
        first = cut(first.groupBy("p").agg(F.min(F.struct("d", "q", "b")).alias("x")))
        at = todo.withColumn("p", _bits("h", 64, top)).join(first, "p", "left")
        done = at.where("x IS NOT NULL").select("doc_id", "n_bytes", "x.d", "x.q", F.col("x.b").alias("b"))
        found.append(cut(done))
        rest = cut(at.where("x IS NULL").select("doc_id", "n_bytes", "h"))
        drop(todo, hist, first)
        todo, base = rest, top
        if rest.isEmpty():
            break
    drop(todo)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    bucket = F.when(F.col("d") == 0, "").otherwise(F.expr("right(lpad(bin(q), 64, '0'), d)"))
    return out.select(
        "doc_id", "n_bytes", F.col("d").alias("depth"), bucket.alias("bucket"), F.col("b").alias("shard_bytes"), (F.col("b") > limit).alias("oversized")
    )
