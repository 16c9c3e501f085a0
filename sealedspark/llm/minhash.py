"""MinHash near-duplicates with circulant signatures.

One permutation (a 32-bit bijection) scatters a document's shingles; a second one, circularly shifted by
0, 1, 2, ..., gives every coordinate of the signature: ``sig[k] = min over s of pi((sigma(s) + k) mod 2**32)``.
All coordinates are there before banding starts. Documents with one sequence of words, told by a SHA-256, form a class;
only a class's smallest doc_id goes on. Classes that share a band are candidates; exact Jaccard similarity of the
full sets of words confirms a link.

A bucket of n classes is never expanded into its n**2 pairs. Its members are first compared with the smallest
of them; connected components follow from the confirmed links. The classes of buckets that then still hold more
than one component are joined on rare shingles: their shingles are put in order from the rarest, and two sets can
only reach the threshold if they share one near the front of both, so far ahead that what is left suffices. This
prefix and position filter loses no pair, and what it leaves is compared exactly. So each pair of a bucket is
compared, known to be connected, or shown to be too different.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealedspark.llm.common import blocks, cut, drop, free_shuffles, in_parts, maybe_broadcast, mix32, mix64, shingle_hashes, shingle_set, word_digest
from sealedspark.llm.graph import components

# At most so many ids are broadcast (8 bytes each); more are joined by shuffle.
MAX_IDS = 1_000_000
_SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("fp", T.BinaryType()),
    T.StructField("n", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
])


def circulant_signature(shingles: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Signatures (texts x size, uint32) of the non-empty runs of `shingles` that `bounds` separates."""
    sigma = mix32((shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32))
    sig = np.empty((size, len(bounds) - 1), np.uint32)
    begin = bounds[:-1]
    for k in range(size):
        sig[k] = np.minimum.reduceat(mix32(sigma + np.uint32(k)), begin)
    return sig.T


def _distinct(texts: list, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, end to end and in order, and the number of the text of each."""
    h, bounds = shingle_hashes(texts, words)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _sign(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for i, j in blocks(texts, 1 << 18):
                h, doc = _distinct(texts[i:j], words)
                n = np.bincount(doc, minlength=j - i)
                full = np.flatnonzero(n)
                prints = [b""] * (j - i)
                band = np.zeros((0, bands), np.uint64)
                if len(full):
                    runs = np.concatenate([[0], np.cumsum(n[full])])
                    for d in full:
                        prints[d] = word_digest(texts[i + d])
                    sig = circulant_signature(h, runs, bands * rows).astype(np.uint64).reshape(len(full), bands, rows)
                    band = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(full), bands)).copy()
                    for r in range(rows):
                        band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(band.view(np.int64).ravel()))
                out = [ids[i:j], pa.array(prints, pa.binary()), pa.array(n, pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(out, names=_SIGNED.names)

    return run


def _verify(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, root = None, set()
        for batch in batches:
            keep = []
            for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b")), strict=True):
                if last != a:
                    last, root = a, shingle_set(ta, words)
                own = shingle_set(tb, words)
                both = len(root & own)
                keep.append(100 * both >= percent * (len(root) + len(own) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, comps = (batch.column(c).to_numpy() for c in ("rep", "comp"))
            texts = batch.column("text").to_pylist()
            for i, j in blocks(texts, 1 << 18):
                h, doc = _distinct(texts[i:j], words)
                n = np.bincount(doc, minlength=j - i)[doc]
                for lo in range(0, len(h), 1 << 16):
                    at = slice(lo, lo + (1 << 16))
                    cols = [pa.array(c) for c in (reps[i:j][doc[at]], comps[i:j][doc[at]], n[at], h[at].view(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names=["rep", "comp", "n", "h"])

    return run


def _rare_pairs(texts: DataFrame, left: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of `left` (rep, comp) of different components that may reach `percent`; none that does is missing.

    Shingles are taken from the rarest on. If the first one that two sets share is the i-th of n and the j-th of
    m (from 0), they share at most min(n - i, m - j), and need percent / (100 + percent) * (n + m). Shingles of one
    set only are counted, but kept out of the join.
    """
    rows = cut(left.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "comp", "text").mapInArrow(in_parts(_shingles(words)), "rep long, comp long, n long, h long"))
    many = cut(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    held = rows.join(many, "h").withColumn("k", F.count("*").over(Window.partitionBy("rep")))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "h"))
    held = held.withColumn("i", F.col("n") - F.col("k") + place - 1).where(f"100 * (n - i) >= {percent} * n")
    front = cut(held.select("h", "rep", "comp", "n", "i"))
    # a shingle held by one component only makes no pair; else all but its largest component meet every other member
    sizes = front.groupBy("h", "comp").agg(F.count("*").alias("m"))
    main = sizes.groupBy("h").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("c")).where("c > 1").select("h", "main")
    main = cut(main)
    met = cut(front.join(main, "h"))
    drop(rows, many, front, main)
    one = met.where("comp <> main").select("h", F.col("rep").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("i").alias("ia"))
    other = met.select(F.col("h").alias("hb"), F.col("rep").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("i").alias("ib"), "main")
    enough = f"{100 + percent} * least(na - ia, nb - ib) >= {percent} * (na + nb)"
    on = F.expr(f"h = hb AND ca <> cb AND (cb = main OR a < b) AND {enough}")
    out = cut(one.join(other, on).select("a", "b"))
    drop(met)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """Near-duplicate components of `docs` (doc_id, text; other columns are ignored).

    Returns one row per input row: doc_id, n_shingles (size of its set of `words`-word shingles),
    component_id (smallest doc_id that links reach), kept (doc_id = component_id). Two documents are linked
    if 100 * intersection >= percent * union. Null, empty and blank texts have no shingles and link with
    nothing. Repeated rows with one doc_id are one document of the graph (links of differing texts under one
    doc_id are confirmed on the smallest of them). A null doc_id has a null component_id and is kept. At a similarity of 0.8, 32 bands of 5 miss a pair with a chance of 3e-6.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(src.mapInArrow(in_parts(_sign(words, bands, rows)), _SIGNED))
    member = signed.select("doc_id", "fp", "n")
    some = member.where("n > 0 AND doc_id IS NOT NULL")
    reps = cut(some.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    first = signed.join(reps, "fp").where("doc_id = rep")
    spread = first.select("rep", "n", F.explode("bands").alias("bucket"))
    ends = spread.groupBy("bucket").agg(F.min("rep").alias("lo"), F.min_by("n", "rep").alias("nlo"), F.max("rep").alias("hi"))
    ends = cut(ends.where("lo < hi").drop("hi"))
    live = cut(spread.join(ends, "bucket").select("bucket", "rep", "n", "lo", "nlo").distinct())
    ids = maybe_broadcast(cut(live.select(F.col("rep").alias("doc_id")).distinct()), MAX_IDS)
    texts = cut(src.join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")))
    drop(ends)
    free_shuffles(spark)

    def confirm(pairs: DataFrame) -> DataFrame:
        """Links among `pairs` (a, b) by exact similarity."""
        pairs = cut(pairs.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").where("a < b").distinct())
        with_b = pairs.join(texts.selectExpr("doc_id AS b", "text AS text_b"), "b")
        both = with_b.join(texts.selectExpr("doc_id AS a", "text AS text_a"), "a")
        out = cut(both.select("a", "b", "text_a", "text_b").mapInArrow(in_parts(_verify(words, percent), "text_b"), "a long, b long"))
        drop(pairs)
        return out

    # sizes too far apart rule a pair out
    fit = f"100 * least({{0}}, {{1}}) >= {percent} * greatest({{0}}, {{1}})"
    links = confirm(live.where(fit.format("n", "nlo")).select(F.col("lo").alias("a"), F.col("rep").alias("b")))
    comp = cut(components(links))
    at = live.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("comp", "rep").alias("comp"))
    open_ = at.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("bucket")
    left = cut(at.join(open_, "bucket").select("rep", "comp").distinct())
    rest = _rare_pairs(texts, left, words, percent)
    links2 = confirm(rest)
    joined = cut(components(links.union(links2)))
    drop(comp, left, texts, live, links, links2, rest)
    comp = joined
    free_shuffles(spark)

    rep_of = member.where("n > 0 AND doc_id IS NOT NULL").join(reps, "fp")
    rep_of = rep_of.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    found = rep_of.select("doc_id", "n", F.coalesce("comp", "rep").alias("component_id"))
    alone = member.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = found.union(alone)
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """`docs` with one document of each near-duplicate group: that with the smallest doc_id.

    Columns stay as they are; of repeated rows with one doc_id one stays. Rows without doc_id all stay.
    """
    gone = cut(near_duplicates(docs, **how).where("NOT kept").select(F.col("doc_id").alias("__id")).distinct())
    ident = F.col("doc_id").cast("long")
    many = cut(docs.groupBy(ident.alias("__id")).count().where("count > 1 AND __id IS NOT NULL").select("__id"))
    # ids are broadcast up to a checked number (8 bytes each), so that texts are only shuffled beyond it
    out, many = maybe_broadcast(gone.union(many), MAX_IDS), maybe_broadcast(many.join(gone, "__id", "left_anti"), MAX_IDS)
    once = docs.join(out, ident == F.col("__id"), "left_anti")
    return once.unionByName(docs.join(many, ident == F.col("__id"), "left_semi").dropDuplicates(["doc_id"]))
