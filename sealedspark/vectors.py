"""Vector columns: dot products, norms, quantisation and hashed bags of words, all in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column, zero: str = "double") -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast(zero), lambda s, x: s + x)


def norm(v: Column) -> Column:
    v = v.cast("array<double>")
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; a zero norm counts as 1."""
    one = lambda c: F.when(norm(c) == 0, F.lit(1.0)).otherwise(norm(c))
    return dot(a.cast("array<double>"), b.cast("array<double>")) / (one(a) * one(b))


def quantize(v: Column, quant_bits: int) -> Column:
    """round-half-even(x * 10**quant_bits) of each component, computed in double precision."""
    if not 0 <= quant_bits <= 3:
        raise ValueError("quant_bits is 0 to 3: the discrete logarithm's range grows with its square")
    return F.transform(v, lambda x: F.rint(x.cast("double") * F.lit(float(10**quant_bits))).cast("bigint"))


def l2_normalize(v: Column, dim: int) -> Column:
    """`v` padded with zeros or cut to `dim`, divided by its norm unless that is at most 1e-12."""
    fit = F.slice(F.concat(v.cast("array<double>"), F.array_repeat(F.lit(0.0), dim)), 1, dim)
    # the norm is put into the array's end, so that it is computed once
    with_norm = F.concat(fit, F.array(norm(fit)))
    return F.transform(F.array(with_norm), lambda w: F.when(F.get(w, dim) > 1e-12, F.transform(F.slice(w, 1, dim), lambda x: x / F.get(w, dim))).otherwise(F.slice(w, 1, dim)))[0]


def _bucket(word: Column, dim: int) -> Column:
    """int(md5 hex) modulo dim, eight hex digits at a time."""
    h, at = F.md5(word.cast("binary")), F.lit(0).cast("bigint")
    for i in range(3 if 2**32 % dim == 0 else 0, 4):  # what is above the last 32 bits is a multiple of such a dim
        part = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")
        at = (at * F.lit(2**32 % dim) + part) % F.lit(dim)
    return at


def hash_embed(docs: DataFrame, dim: int) -> DataFrame:
    """doc_id, bucket, n: how many words of a text fall in each md5 bucket; the sparse form of the embedding.

    Words are counted per document first, so that each of its distinct words is hashed once. Texts are moved to where
    their document is counted, and words are then made and counted there: one shuffle of texts, none of words.
    """
    words = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", F.explode(F.split(F.lower("text"), r"(?U)\s+")).alias("word"))
    counted = words.where("word <> ''").groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return counted.groupBy("doc_id", _bucket(F.col("word"), dim).alias("bucket")).agg(F.sum("n").alias("n"))


def hash_vectors(docs: DataFrame, dim: int, normalize: bool = True) -> DataFrame:
    """doc_id, vec: the dense hashed bag of words of every document, of length `dim`; zeros for a text without words."""
    held = hash_embed(docs, dim).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("n").cast("double")))).alias("m"))
    all_ = docs.select("doc_id").distinct().join(held, "doc_id", "left")
    at = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(dim - 1).cast("bigint")), lambda i: F.coalesce(F.get(F.array(F.try_element_at("m", i)), F.lit(0)), F.lit(0.0)))
    dense = all_.select("doc_id", at.alias("vec"))
    return dense.select("doc_id", l2_normalize(F.col("vec"), dim).alias("vec")) if normalize else dense
