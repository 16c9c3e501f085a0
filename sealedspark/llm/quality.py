"""Quality by perplexity under an interpolated modified Kneser-Ney model of character 4-grams.

The model counts trusted text only. An n-gram is packed into 64 bits, 16 per character, so that counts,
continuation counts and backing off are shifts, groupings and joins of integer columns in Spark, sharded by
hash. Documents are first reduced to the distinct 4-grams of the whole corpus; these are scored by joins with
the model's tables. Each document then sums the scores of its 4-grams: against a broadcast table where that has
a checked size, by a shuffle join beyond it. A document is rejected above its language's perplexity threshold,
a quantile over trusted documents that the model was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealedspark.llm.common import cut, free_shuffles, in_parts, maybe_broadcast, small_enough

ORDER = 4
# At most so many trusted ids are broadcast (8 bytes each); more are joined by shuffle.
MAX_TRUSTED = 1_000_000
# Logarithms are summed as whole multiples of this, so that no sum depends on its order or on the way of the join.
UNIT = 2.0**-30
_START = np.full(ORDER - 1, 2, np.uint64)


def grams(text: str | None) -> np.ndarray:
    """The packed 4-gram that ends at each character; digits count as 0, white space as a space."""
    if not text:
        return np.zeros(0, np.uint64)
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    c[c > 0xFFFF] = 0xFFFD
    c[(c >= 48) & (c <= 57)] = 48
    c[(c <= 32) | (c == 160)] = 32
    c = np.concatenate([_START, c])
    n = len(c) - ORDER + 1
    out = np.zeros(n, np.uint64)
    for j in range(ORDER):
        out = (out << np.uint64(16)) | c[j : j + n]
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, c: 4-grams counted once per block of texts, before they are shuffled."""

    def flush(parts):
        key, c = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c, pa.int64())], names=["key", "c"])

    parts, size = [], 0
    for batch in batches:
        for t in batch.column("text").to_pylist():
            parts.append(grams(t))
            size += len(parts[-1])
            if size > 1 << 21:
                yield flush(parts)
                parts, size = [], 0
    if size:
        yield flush(parts)


def _count(docs: DataFrame) -> DataFrame:
    return docs.select("text").mapInArrow(in_parts(_counted), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _discounts(t: DataFrame) -> list[float]:
    """D1, D2 and D3+ of one order from its counts of counts (one row); plain values where these are too few."""
    r = t.agg(*(F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in range(1, 5))).first()
    n1, n2, n3, n4 = r
    if not (n1 and n2 and n3 and n4):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True)]


def train(trusted: DataFrame) -> dict:
    """The model of `trusted` (text): per order n, tables `p` (key, p) and `g` (ctx, gamma), and `floor`."""
    tables = {ORDER: cut(_count(trusted))}
    for n in range(ORDER - 1, 0, -1):
        mask = (1 << (16 * n)) - 1
        tables[n] = cut(tables[n + 1].groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.count("*").alias("c")))
    floor = 1.0 / (tables[1].count() + 1)
    model, below = {"floor": floor}, None
    for n in range(1, ORDER + 1):
        d = _discounts(tables[n])
        disc = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        t = tables[n].select("key", F.shiftrightunsigned("key", 16).alias("ctx"), "c", disc.alias("d"))
        g = cut(t.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma")))
        t = t.join(g, "ctx").select("key", "gamma", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"))
        if below is None:
            p = t.select("key", (F.col("own") + F.col("gamma") * floor).alias("p"))
        else:
            low = F.col("key").bitwiseAND(F.lit((1 << (16 * (n - 1))) - 1))
            p = t.withColumn("low", low).join(below.select(F.col("key").alias("low"), F.col("p").alias("pl")), "low")
            p = p.select("key", (F.col("own") + F.col("gamma") * F.col("pl")).alias("p"))
        below = cut(p)
        model[n] = (below, g.select("ctx", "gamma"))
    return model


def score_grams(keys: DataFrame, model: dict) -> DataFrame:
    """key, logp of every 4-gram of `keys` (key, distinct): the longest known order, backed off."""
    at = keys.select("key")
    at = at.withColumn("p", F.lit(float(model["floor"])))
    for n in range(1, ORDER + 1):
        p, g = model[n]
        sub = F.col("key") if n == ORDER else F.col("key").bitwiseAND(F.lit((1 << (16 * n)) - 1))
        at = at.withColumn("sub", sub).withColumn("ctx", F.shiftrightunsigned("sub", 16))
        at = at.join(p.select(F.col("key").alias("sub"), F.col("p").alias("pn")), "sub", "left").join(g, "ctx", "left")
        at = at.select("key", F.coalesce("pn", F.coalesce("gamma", F.lit(1.0)) * F.col("p")).alias("p"))
    return at.select("key", F.log("p").alias("logp"))


def _sum_with(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = (np.frombuffer(b, t) for b, t in zip(shared.value, (np.uint64, np.int64), strict=True))
        for batch in batches:
            sums, sizes = [], []
            for t in pc.struct_field(batch.column("__doc"), "text").to_pylist():
                k = grams(t)
                sums.append(int(logs[np.searchsorted(keys, k)].sum()) if len(k) else 0)
                sizes.append(len(k))
            yield pa.RecordBatch.from_arrays([batch.column("__doc"), pa.array(sums, pa.int64()), pa.array(sizes, pa.int64())], names=["__doc", "s", "n"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, t in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            key, c = np.unique(grams(t), return_counts=True)
            cols = [pa.array(np.full(len(key), row)), pa.array(key.view(np.int64)), pa.array(c, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "key", "c"])


def scorer(docs: DataFrame, model: dict, max_broadcast: int = 2_000_000):
    """A function that adds `perplexity` to rows of `docs` given as one struct __doc; null for a null or empty text.

    Up to `max_broadcast` distinct 4-grams (16 bytes each) are broadcast: documents then pass by once and are
    neither stored nor shuffled. More are joined by shuffle, over a copy of the rows with fixed row numbers.
    """
    scored = score_grams(_count(docs).select("key"), model)
    scored = cut(scored.select("key", F.round(F.col("logp") / F.lit(UNIT)).cast("long").alias("logp")))
    if small_enough(scored, max_broadcast):
        t = scored.toArrow()
        keys = t.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        pair = (keys[order].tobytes(), t.column("logp").to_numpy()[order].tobytes())
        shared = docs.sparkSession.sparkContext.broadcast(pair)

    def add(rows: DataFrame) -> DataFrame:
        if small_enough(scored, max_broadcast):
            kind = T.StructType([rows.schema["__doc"], T.StructField("s", T.LongType()), T.StructField("n", T.LongType())])
            sums = rows.select("__doc").mapInArrow(in_parts(_sum_with(shared), "__doc.text"), kind)
        else:
            fixed = cut(rows.select(F.monotonically_increasing_id().alias("row"), "__doc"))
            each = fixed.select("row", "__doc.text").mapInArrow(in_parts(_spread), "row long, key long, c long").join(scored, "key")
            sums = each.groupBy("row").agg(F.sum(F.col("c") * F.col("logp")).alias("s"), F.sum("c").alias("n"))
            sums = fixed.join(sums, "row", "left")
        return sums.select("__doc", F.when(F.col("n") > 0, F.exp(-F.col("s") * F.lit(UNIT) / F.col("n"))).alias("perplexity"))

    return add


def score(docs: DataFrame, labels: DataFrame, quantile: float = 0.98, slack: float = 1.25, max_broadcast: int = 2_000_000) -> DataFrame:
    """A perplexity and a decision for every row of `docs` (doc_id, text, lang; other columns stay, in __doc).

    Trusted are documents whose labels all say quality 1 and toxic 0; a fifth of them, by hash of doc_id, is
    kept out of the training and sets each language's threshold: `slack` times the `quantile` of their
    perplexities (that over all languages where a language, or null, has fewer than 20). Returns __doc (the row
    as it came), perplexity, threshold, rejected. A null or empty text has no perplexity and is not
    rejected; nor is any document where nothing is trusted. Repeated rows are judged each.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"))
    good = labels.groupBy(F.col("doc_id").cast("long").alias("id"))
    good = good.agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND t = 0").select("id")
    held = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    # trusted ids (8 bytes each) are broadcast up to a checked number, so that texts are not shuffled
    trusted = rows.withColumn("id", F.col("__doc.doc_id").cast("long")).join(maybe_broadcast(cut(good), MAX_TRUSTED), "id", "left_semi")
    model = train(trusted.where(~held).select("__doc.text"))
    add = scorer(rows.select("__doc.text"), model, max_broadcast)
    used = F.struct(F.col("__doc.text").alias("text"), F.col("__doc.lang").alias("lang")).alias("__doc")
    test = cut(add(trusted.where(held).select(used)).select("__doc.lang", "perplexity").where("perplexity IS NOT NULL"))
    q = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("q")
    by_lang = test.groupBy("lang").agg(q, F.count("*").alias("n")).where("n >= 20 AND lang IS NOT NULL").select("lang", "q")
    overall = test.agg(q).first()["q"]
    out = add(rows).withColumn("lang", F.col("__doc.lang")).join(maybe_broadcast(cut(by_lang), 100_000), "lang", "left")
    limit = F.coalesce(F.col("q"), F.lit(overall).cast("double")) * slack
    out = out.withColumn("threshold", limit)
    free_shuffles(docs.sparkSession)
    return out.select("__doc", "perplexity", "threshold", F.coalesce(F.col("perplexity") > F.col("threshold"), F.lit(False)).alias("rejected"))
