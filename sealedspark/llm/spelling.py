"""Spelling variants: words one edit apart, found by deletion keys, grouped under their most frequent neighbour.

Every word of n code points has n deletions. Two words of one length are near if they share the deletion of one
position; two of neighbouring lengths if one is a deletion of the other. The keys of all deletions of a word come
from polynomial hashes of its prefixes and suffixes, by numpy over all words of a length at once. Keys are dealt
out by their leading bits and sorted there; what no other word shares is gone after that. What is left is compared
by the deleted strings themselves, so colliding keys link nothing, and no pair is written out: a group of
substitutions keeps its size and its two best words, a group of insertions its centre and its best member. Such
groups are bounded by the alphabet and the length of a word, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealedspark.llm.common import crc32_sql, cut, drop

_PRIMES = (2**31 - 1, 2**31 - 19)
_BASES = (1_103_515_245, 1_566_083_941)
# A bucket of keys holds about so many records (20 bytes each); there are 1,024 buckets at least.
PER_BUCKET, LEAST_BITS = 1 << 16, 10
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KEY_BITS = 62


def runs(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, run: the maximal runs of letters of `least` code points or more, A-Z lower-cased; null has none."""
    low = F.translate("text", *LOWER)
    found = F.regexp_extract_all(low, F.lit(f"[a-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(found).alias("run"))


def with_typos(every: int = 31) -> Column:
    """The run, or where `every` divides h, the crc32 of doc_id:run, the run without its code point h % length."""
    run = F.col("run")
    h = F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), run).cast("binary"))
    i = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(run.substr(F.lit(1), i), run.substr(i + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, least_length: int = 7, least_n: int = 2, every: int = 31) -> DataFrame:
    """word, n of all runs of `docs` (doc_id, text; other columns are ignored) after `with_typos`, over whole texts.

    Words have `least_length` code points and `least_n` occurrences at least. Null texts have none, a null doc_id
    counts as an empty one, repeated rows count each.
    """
    words = runs(docs, least_length).select(with_typos(every).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _keys_of(letters: np.ndarray) -> np.ndarray:
    """The key of each row of letters (m x n) and of its n deletions: m x (n + 1), the whole word first."""
    m, n = letters.shape
    out = np.zeros((m, n + 1), np.uint64)
    for p, b in zip(_PRIMES, _BASES, strict=True):
        p, b = np.uint64(p), np.uint64(b)
        power = np.ones(n + 1, np.uint64)
        for i in range(n):
            power[i + 1] = power[i] * b % p
        before = np.zeros((n + 1, m), np.uint64)  # hash of the first i letters
        after = np.zeros((n + 1, m), np.uint64)  # hash of the letters from i on
        for i in range(n):
            before[i + 1] = (before[i] * b + letters[:, i]) % p
            j = n - 1 - i
            after[j] = (letters[:, j] * power[i] + after[j + 1]) % p
        gone = (before[:n] * power[n - 1 :: -1][:n, None] + after[1:]) % p
        out[:, 0] = (out[:, 0] << np.uint64(31)) | before[n]
        out[:, 1:] = (out[:, 1:] << np.uint64(31)) | gone.T
    return out


def _deletion_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, pos, id of every word (pos -1) and of each of its deletions, about a million letters at a time."""
    for batch in batches:
        words, ids = batch.column("word").to_pylist(), batch.column("id").to_numpy()
        size = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            step = max(1, (1 << 20) // int(n + 1))
            for part in (own[i : i + step] for i in range(0, len(own), step)):
                text = "".join(words[i] for i in part).encode("utf-32-le", "surrogatepass")
                letters = np.frombuffer(text, np.uint32).reshape(len(part), n).astype(np.uint64) + np.uint64(1)
                keys = _keys_of(letters).view(np.int64)
                pos = np.tile(np.arange(-1, n, dtype=np.int32), len(part))
                cols = [pa.array(keys.ravel()), pa.array(pos), pa.array(np.repeat(ids[part], n + 1))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "pos", "id"])


def _shared(bucket: pa.Table) -> pa.Table:
    """pos, id of the records of one bucket whose key another word shares: at the same position, or as its whole."""
    key, pos, ids = (bucket.column(c).to_numpy() for c in ("key", "pos", "id"))
    order = np.lexsort((pos, key))
    key, pos, ids = key[order], pos[order], ids[order]
    next_key = key[1:] == key[:-1]
    same = next_key & (pos[1:] == pos[:-1])
    keep = np.append(False, same) | np.append(same, False)
    start = np.flatnonzero(np.append(True, ~next_key)[: len(key)])
    length = np.diff(np.append(start, len(key)))
    keep |= np.repeat((pos[start] == -1) & (length > 1), length)
    return pa.table({"pos": pa.array(pos[keep]), "id": pa.array(ids[keep])})


def _neighbours(words: DataFrame) -> DataFrame:
    """id, n_near, best (least: less n, then word) of every word of `words` (id, word, n) that has a near one."""
    records = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    bits = max(LEAST_BITS, int(records // PER_BUCKET).bit_length())
    keys = words.select("id", "word").mapInArrow(_deletion_keys, "key long, pos int, id long")
    keys = keys.withColumn("radix", F.shiftright("key", KEY_BITS - bits))
    found = keys.groupBy("radix").applyInArrow(_shared, "pos int, id long")
    c = found.join(words, "id")
    at = F.col("pos") + 1
    letter = F.col("word").substr(at, F.lit(1))
    first = (F.col("pos") == 0) | (letter != F.col("word").substr(F.col("pos"), F.lit(1)))
    rest = F.concat(F.col("word").substr(F.lit(1), F.col("pos")), F.col("word").substr(at + 1, F.length("word")))
    me = F.struct((-F.col("n")).alias("n"), "word").alias("me")
    whole = F.col("pos") == -1
    c = c.select("id", me, "pos", whole.alias("whole"), F.when(whole, F.col("word")).otherwise(rest).alias("left"), (~whole & first).alias("first"))
    by, at_pos = Window.partitionBy("left"), Window.partitionBy("left", "pos")
    ordered = at_pos.orderBy("me").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = c.select(
        "id", "me", "whole", "first",
        F.count(F.when(F.col("first"), 1)).over(by).alias("members"),
        F.min(F.when(F.col("first"), F.col("me"))).over(by).alias("member"),
        F.min(F.when(F.col("whole"), F.col("me"))).over(by).alias("centre"),
        F.count("*").over(at_pos).alias("size"),
        F.first("me").over(ordered).alias("one"),
        F.nth_value("me", 2).over(ordered).alias("two"),
    )
    centre = F.col("first") & F.col("centre").isNotNull()
    near = F.when(F.col("whole"), F.col("members")).otherwise(F.col("size") - 1 + centre.cast("long"))
    other = F.when(F.col("one.word") == F.col("me.word"), F.col("two")).otherwise(F.col("one"))
    best = F.when(F.col("whole"), F.col("member")).otherwise(F.least(other, F.when(centre, F.col("centre"))))
    return c.select("id", near.alias("near"), best.alias("best")).groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """word, root for `links` (word, to): where following links ends. Each step doubles the way; n grows tenfold
    at each link (or by the given ratio), so a way is short and a few steps end it."""
    at = cut(links.select("word", F.col("to").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop(at)
        at = new
        if not at.where("moved").count():
            return at.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of `words` (word, n; distinct words, other columns are ignored).

    Near words differ by one inserted, deleted or replaced code point; n_near counts them. form is the near word of
    largest n (ties: smallest in code-point order) if that n is `ratio` (at least 2) times the word's n or more,
    form_n its n, else null. root is where forms lead to in the end, the word itself without one. Null words and
    counts are left out; an empty word is near to words of one code point. Words of any length are taken in whole.
    """
    if ratio < 2:
        raise ValueError("a form is at least twice as frequent")
    w = words.select("word", F.col("n").cast("long").alias("n")).where("word IS NOT NULL AND n IS NOT NULL")
    w = cut(w.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    form = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best"))
    near = cut(w.join(_neighbours(w), "id", "left").withColumn("f", form))
    near = near.select("word", F.col("f.word").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("f.n")).alias("form_n"))
    roots = _roots(near.where("form IS NOT NULL").select("word", F.col("form").alias("to")))
    out = near.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """DuckDB SQL for `group_variants` of `count_words` over table documents."""
    low = f"translate(text, '{LOWER[0]}', '{LOWER[1]}')"
    return f"""WITH RECURSIVE runs AS (SELECT w, coalesce(doc_id::VARCHAR, '') || ':' || w AS k FROM (SELECT doc_id, unnest(regexp_extract_all({low}, '[a-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) > 6),
{crc32_sql("SELECT DISTINCT k FROM runs")},
typed AS (SELECT CASE WHEN crc % 31 = 0 THEN left(w, (crc % length(w))::INT) || substr(w, (crc % length(w))::INT + 2) ELSE w END AS word FROM runs JOIN crcs ON s = k),
v AS (SELECT word, count(*) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
d AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS g FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.g = b.g AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.g UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.g),
b AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM p GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM v LEFT JOIN b USING (word)),
way AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT way.word, f.form, step + 1 FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM way GROUP BY word) USING (word)"""
