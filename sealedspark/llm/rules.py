"""Quality rules in DataFrame functions alone: base counts, and a hashed n-gram log-likelihood ratio.

The features of a text are its words and pairs of neighbouring words, by crc32 in `buckets` buckets. A bucket's
weight is the logarithm of its probability in trusted documents over that in all documents (two multinomials;
the first is smoothed by the second). A document's score is the mean weight of its features. Weights are whole
millionths, so sums do not depend on their order; the threshold comes from trusted documents that the model
has not seen, through a histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealedspark.llm.common import crc32_sql, cut, drop, maybe_broadcast

# At most so many trusted ids (8 bytes each) are broadcast; beyond that documents are joined to them by shuffle.
MAX_TRUSTED = 1_000_000
BUCKETS = 1 << 16
UNIT, BIN = 1_000_000, 100  # weights in millionths; histogram bins of a hundred of them
WORD, SYMBOLS = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"


def trusted_ids(labels: DataFrame) -> DataFrame:
    """id, held for documents whose labels all say quality 1 and toxic 0; a fifth, by crc32 of the id, is held out."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    return good.where("q = 1 AND t = 0 AND id IS NOT NULL").select("id", held.alias("held"))


def _marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, text, held: null for a document that is not trusted."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.join(trusted, d["doc_id"] == trusted["id"], "left").drop("id")


def _bucket(text: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(text.cast("binary")), F.lit(buckets)).cast("int")


def _features(rows: DataFrame, keep: list, buckets: int) -> DataFrame:
    """One row per feature of `words` with the columns `keep`; a row without words gives one, with a null bucket."""
    pairs = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, 2147483647).alias("b"))
    each = rows.select(*keep, F.inline_outer(pairs).alias("a", "b"))
    both = F.array(_bucket(F.col("a"), buckets), _bucket(F.concat("a", F.lit(" "), "b"), buckets))
    each = each.select(*keep, F.explode(both).alias("bucket"), F.col("a").isNull().alias("empty"))
    return each.where("bucket IS NOT NULL OR empty")


def weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, weight (millionths) for every bucket that a document has. At most `buckets` rows."""
    d = _marked(docs, trusted).select((~F.coalesce("held", F.lit(True))).cast("long").alias("own"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    c = _features(d, ["own"], buckets).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("own").alias("m"))
    c = cut(c)
    total = c.agg(F.sum("n"), F.sum("m")).first()
    n, m = total[0] or 0, total[1] or 0
    raw = (F.col("n") + 1) / F.lit(float(n + buckets))
    own = (F.col("m") + buckets * raw) / F.lit(float(m + buckets))
    w = cut(c.select("bucket", F.floor(F.log(own / raw) * UNIT).cast("long").alias("weight")))
    drop(c)
    return w


def _repeat_words(rows: DataFrame) -> DataFrame:
    """`rows` with n_repeat_words: words covered by a window of three words that the text has twice or more.

    Windows are compared by hash first; only texts in which two hashes agree sort their windows, hash and words
    together, so that what counts as equal has equal words. Nothing leaves the row.
    """
    w = F.col("words")
    heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
    at = lambda i, k: F.get(w, i + k)
    hashes = F.transform(heads, lambda x, i: F.xxhash64(x, at(i, 1), at(i, 2)))
    rows = rows.withColumn("__h", hashes)
    window = lambda h, i: F.struct(h.alias("h"), at(i, 0).alias("a"), at(i, 1).alias("b"), at(i, 2).alias("c"), i.alias("i"))
    some = F.size(F.array_distinct("__h")) < F.size("__h")
    rows = rows.withColumn("__s", F.when(some, F.array_sort(F.transform("__h", window)))).drop("__h")
    s = F.col("__s")
    same = lambda x, y: (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    twice = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
    rows = rows.withColumn("__p", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("__s")
    p = F.col("__p")
    own = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
    total = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("__p")


def base_counts(docs: DataFrame) -> DataFrame:
    """`docs` (text, not null; others stay) with words, the base counts and base_failed."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    rows = docs.withColumn("words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).withColumn("__lines", lines)
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    }).drop("__lines", "text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return _repeat_words(rows).withColumn("base_failed", failed)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, quantile: float = 0.01, slack: float = 1.5) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, the base counts, base_failed,
    n_features, score (mean weight in millionths; null without words), threshold and kept.

    kept is false where base_failed, else whether the score reaches the threshold: the median of the held-out
    trusted documents that pass the base rules, less `slack` times the way from it down to their `quantile`
    (both by bins of a ten-thousandth). Without such documents the threshold is null and rejects nothing. A null
    text counts as empty: no words, base_failed. Repeated rows are judged each; a null doc_id is never trusted.
    The counts cover all texts in whole; every document is scored.
    """
    trusted = maybe_broadcast(cut(trusted_ids(labels)), MAX_TRUSTED)
    w = weights(docs, trusted, buckets)
    rows = base_counts(_marked(docs, trusted).withColumn("row", F.monotonically_increasing_id()))
    keep = ["row", "doc_id", "held", *BASE]
    # at most `buckets` weights are broadcast, a bound that does not depend on the data
    each = _features(rows, keep, buckets).join(F.broadcast(w), "bucket", "left")
    one = [F.first(c).alias(c) for c in keep[1:]]
    s = cut(each.groupBy("row").agg(*one, F.count("bucket").alias("n_features"), F.sum("weight").alias("total")))
    s = s.withColumn("score", F.col("total") / F.when(F.col("n_features") > 0, F.col("n_features")))
    bins = s.where("held AND NOT base_failed AND score IS NOT NULL").groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    limit = _threshold(bins, quantile, slack)
    out = s.withColumn("threshold", F.lit(limit).cast("double"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= F.col("threshold"), F.lit(True))
    return out.select("doc_id", *BASE, "n_features", "score", "threshold", kept.alias("kept"))


def _threshold(bins: DataFrame, quantile: float, slack: float) -> float | None:
    """From a histogram, whose bins (weights lie within +-20 nats) are bounded however many documents there are."""
    total = bins.agg(F.sum("n")).first()[0]
    if not total:
        return None
    past = F.expr("sum(n) OVER (ORDER BY bin)")
    c = bins.select("bin", past.alias("past"))
    at = lambda q: F.min(F.when(F.col("past") >= F.lit(q * total), F.col("bin"))) * F.lit(float(BIN))
    low, mid = c.agg(at(quantile), at(0.5)).first()
    return mid - slack * (mid - low)


def oracle(buckets: int = BUCKETS, quantile: float = 0.01, slack: float = 1.5) -> str:
    """DuckDB SQL for the rows of `judge` over tables documents and labels."""
    word = r"[^\x20\x09-\x0D]+"
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
words AS (SELECT r, unnest(w) AS a, unnest(range(len(w))) AS i FROM docs),
grams AS (SELECT r, a AS g FROM words UNION ALL
  SELECT x.r, x.a || ' ' || y.a FROM words x JOIN words y ON y.r = x.r AND y.i = x.i + 1),
{crc32_sql("SELECT DISTINCT g FROM grams UNION SELECT DISTINCT doc_id::VARCHAR FROM labels")},
good AS (SELECT doc_id, (SELECT crc FROM crcs WHERE s = l.doc_id::VARCHAR) % 5 = 0 AS held FROM labels l
  GROUP BY doc_id HAVING min(quality) = 1 AND max(toxic) = 0),
feats AS (SELECT r, crc % {buckets} AS b FROM grams JOIN crcs ON s = g),
cnt AS (SELECT b, count(*) AS n, count(*) FILTER (NOT held) AS m FROM feats JOIN docs USING (r) LEFT JOIN good USING (doc_id) GROUP BY b),
raw AS (SELECT b, m, (n + 1) / (sum(n) OVER () + {buckets})::DOUBLE AS p, sum(m) OVER () AS mm FROM cnt),
weight AS (SELECT b, floor(ln(((m + {buckets} * p) / (mm + {buckets})::DOUBLE) / p) * {UNIT})::BIGINT AS w FROM raw),
score AS (SELECT r, count(*) AS k, sum(weight.w) / count(*) AS score FROM feats JOIN weight USING (b) GROUP BY r),
win AS (SELECT x.r, x.i, count(*) OVER (PARTITION BY x.r, x.a, y.a, z.a) > 1 AS twice FROM words x
  JOIN words y ON y.r = x.r AND y.i = x.i + 1 JOIN words z ON z.r = x.r AND z.i = x.i + 2),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest([0, 1, 2]) AS j FROM win WHERE twice) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs)
  WHERE regexp_matches(l, '{word}') GROUP BY r),
base AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM docs LEFT JOIN lines USING (r) LEFT JOIN rep USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
bins AS (SELECT floor(score / {BIN}) AS bin, count(*) AS n FROM failed JOIN score USING (r) JOIN good USING (doc_id) WHERE held AND NOT base_failed GROUP BY 1),
past AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS past, sum(n) OVER () AS total FROM bins),
cuts AS (SELECT min(bin) FILTER (past >= {quantile}::DOUBLE * total) * {BIN}.0::DOUBLE AS low, min(bin) FILTER (past >= 0.5::DOUBLE * total) * {BIN}.0::DOUBLE AS mid FROM past),
lim AS (SELECT mid - {slack}::DOUBLE * (mid - low) AS threshold FROM cuts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(k, 0) AS n_features, score, threshold,
  NOT base_failed AND coalesce(score >= threshold, true) AS kept FROM failed LEFT JOIN score USING (r) CROSS JOIN lim"""
