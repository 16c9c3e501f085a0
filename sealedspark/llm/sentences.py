"""Substring dedup by sliding spans of sentences.

From every sentence on, the shortest run of consecutive sentences of at least `words` words is hashed and joined
over the whole corpus. Of equal runs the first stays, that of the smallest (doc_id, text, position); the sentences
that any other one covers are removed. A passage that starts and ends inside sentences, or that has none, may hold
no such run: for windows of PASSAGE words without one, the run of `words` words with the least hash in the window
is a span too. It depends on the window's words alone, so every repeated passage of PASSAGE words is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealedspark.llm.common import WORD, _powers, blocks, cut, drop, free_shuffles, in_parts, maybe_broadcast, mix64, word_hashes

# A repeated passage of so many words is always found (fixed value).
PASSAGE = 50
# At most so many hashes or keys are broadcast (16 bytes each); more are joined by shuffle.
MAX_KEYS = 1_000_000
_END, _CLOSE, _SPACES = (np.isin(np.arange(256), list(x)) for x in (b".!?", b"\"')]}", b" \t\n\v\f\r"))


def last_words(texts: list[str | None]) -> np.ndarray:
    """Which words of the texts, end to end, end a sentence: those before a blank line or the end of a text, and
    those that end in ., ! or ?, closing quotes and brackets aside."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = _SPACES[data]
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & before)
    if not len(starts):
        return np.zeros(0, bool)
    stops = np.flatnonzero(space & ~before) - 1  # the last byte of each word
    shut = _CLOSE[data[stops]] & (stops > starts)
    ends = _END[data[stops - shut]]
    lines = np.cumsum(data == 10)
    ends[:-1] |= lines[starts[1:]] - lines[stops[:-1]] >= 2
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    of = np.searchsorted(np.cumsum(lens + 1), starts, side="right")
    ends[:-1] |= of[1:] != of[:-1]
    ends[-1] = True
    return ends


def spans(texts: list[str | None], words: int) -> tuple[np.ndarray, ...]:
    """The spans of the texts: hash, number of the text, first word and the word after the last."""
    h, bounds = word_hashes(texts)
    ends = last_words(texts)
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    up, down = _powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n])])

    def hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))

    stop = np.flatnonzero(ends) + 1
    start = np.concatenate([[0], stop[:-1]])
    k = np.searchsorted(stop, start + words)  # the first sentence end with enough words before it
    good = k < len(stop)
    good[good] = doc[stop[k[good]] - 1] == doc[start[good]]
    a, b = start[good], stop[k[good]]
    out = [(hashes(a, b), a, b)]
    p = np.arange(n - PASSAGE + 1) if n >= PASSAGE else np.zeros(0, np.int64)
    p = p[doc[p] == doc[p + PASSAGE - 1]]
    if len(a):
        at = np.searchsorted(a, p)
        p = p[(at == len(a)) | (b[np.minimum(at, len(a) - 1)] > p + PASSAGE)]
    if len(p):
        grams = hashes(np.arange(n - words + 1), np.arange(words, n + 1))
        view = np.lib.stride_tricks.sliding_window_view(grams, PASSAGE - words + 1)
        least = np.concatenate([p[i : i + 100_000] + view[p[i : i + 100_000]].argmin(1) for i in range(0, len(p), 100_000)])
        least = np.unique(least)
        out.append((grams[least], least, least + words))
    x, a, b = (np.concatenate(c) for c in zip(*out, strict=True))
    return x, doc[a], a - bounds[doc[a]], b - bounds[doc[a]]


def _found(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids, keys = (batch.column(c).to_numpy() for c in ("id", "key"))
            for i, j in blocks(texts, 1 << 19):
                x, of, a, b = spans(texts[i:j], words)
                for lo in range(0, len(x), 100_000):
                    s = slice(lo, lo + 100_000)
                    cols = [pa.array(c) for c in (x[s].view(np.int64), ids[i:j][of[s]], keys[i:j][of[s]], a[s] << 32 | b[s])]
                    yield pa.RecordBatch.from_arrays(cols, names=["hash", "id", "key", "span"])

    return run


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lists = batch.column("text").to_pylist(), batch.column("at").to_pylist()
        out, n, gone = [], [], []
        for i, j in blocks(texts, 1 << 19):
            ends = last_words(texts[i:j])
            _, bounds = word_hashes(texts[i:j])
            for x in range(i, j):
                t, own = texts[x], ends[bounds[x - i] : bounds[x - i + 1]]
                n.append(int(own.sum()))
                if not lists[x]:
                    out.append(t)
                    gone.append(0)
                    continue
                off = np.zeros(len(own) + 1, np.int64)
                for span in lists[x]:
                    off[span["lo"]] += 1
                    off[span["end"]] -= 1
                off = np.cumsum(off)[:-1] > 0
                at = [m.start() for m in WORD.finditer(t)]
                at.append(len(t))
                out.append(t[: at[0]] + "".join(t[at[w] : at[w + 1]] for w in np.flatnonzero(~off)))
                sentence = np.concatenate([[0], np.cumsum(own)[:-1]])
                gone.append(len(np.unique(sentence[off])))
        cols = [batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_sentences", "n_removed", "text"])


def dedup(docs: DataFrame, words: int = 32) -> DataFrame:
    """`docs` (doc_id, text; other columns are ignored) without repeated spans: doc_id, n_sentences, n_removed, text.

    Words are separated by ASCII white space and compare without regard to the case of A-Z; white space between
    them does not count. A run of fewer than `words` words (up to PASSAGE) is never removed, whatever its
    sentences. n_removed counts sentences that lose all or some of their words; a removed word goes with the white
    space after it. A span that overlaps its own first occurrence loses only what lies beyond that. Null and empty
    texts stay as they are. Repeated rows, those with one doc_id and one text, are one document and fare alike.
    Rows without doc_id come last in the order of occurrences, among themselves by a hash of the text.
    """
    if not 1 < words <= PASSAGE:
        raise ValueError(f"runs have 2 to {PASSAGE} words")
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), ident.alias("order"), F.xxhash64("text").alias("key"), "text")
    # repeated rows are one document
    src = rows.where("text IS NOT NULL").select(F.col("order").alias("id"), "key", "text")
    all_ = cut(src.mapInArrow(in_parts(_found(words)), "hash long, id long, key long, span long"))  # first word and word after the last
    many = cut(all_.groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("id0")).where("n > 1").select("hash", "id0"))
    free_shuffles(docs.sparkSession)
    held = all_.join(many, "hash").withColumn("pos", F.shiftright("span", 32)).withColumn("end", F.col("span").bitwiseAND(F.lit(2**32 - 1)))
    held = cut(held.select("hash", "id", "id0", "key", "pos", "end"))
    drop(all_, many)
    free_shuffles(docs.sparkSession)
    later = held.where("id > id0").select("id", "key", F.col("pos").alias("lo"), "end")
    # among the rows of the smallest doc_id the first by text and position stays
    own = held.where("id = id0").select("hash", "id", "key", "pos", "end")
    first = own.groupBy("hash").agg(F.min(F.struct("key", "pos", "end")).alias("f"), F.max(F.struct("key", "pos")).alias("l"))
    first = cut(first.where("f.key < l.key OR f.pos < l.pos").select("hash", F.col("f.key").alias("key0"), F.col("f.pos").alias("pos0"), F.col("f.end").alias("end0")))
    own = own.join(first, "hash").where("key > key0 OR (key = key0 AND pos > pos0)")
    lo = F.when(F.col("key") == F.col("key0"), F.greatest("pos", "end0")).otherwise(F.col("pos"))
    both = later.union(own.select("id", "key", lo.alias("lo"), "end")).where("lo < end").distinct()
    # one row per document, whose own length bounds the list
    gone = cut(both.groupBy(F.col("id").alias("order"), "key").agg(F.collect_list(F.struct("lo", "end")).alias("at")))
    drop(held, first)
    keys = maybe_broadcast(gone.select("order", "key"), MAX_KEYS)
    on = ["order", "key"]
    hit = rows.join(keys, on, "left_semi").join(gone, on).select("id", "text", "at")  # only texts that lose words are shuffled
    rest = rows.join(keys, on, "left_anti").select("id", "text", F.lit(None).cast(gone.schema["at"].dataType).alias("at"))
    free_shuffles(docs.sparkSession)
    return hit.union(rest).mapInArrow(in_parts(_rebuild), "doc_id long, n_sentences long, n_removed long, text string")
