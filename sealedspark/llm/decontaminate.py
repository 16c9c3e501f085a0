"""Benchmark decontamination by canonical templates.

Numbers, units and names become typed placeholders; what they stood for are the slots. A capitalised word is a name,
wherever it stands, unless the benchmark has it in lower case. Windows of `width` canonical words of the benchmark are
joined by hash with those of the documents; a window with more slots than words only matches word by word. The windows
that a document and an item share must fill the item's slots consistently: one value for each number's place, and one
for each name. So copies and re-parameterised questions are both found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealedspark.llm.common import _powers, blocks, cut, drop, in_parts, maybe_broadcast, mix64, small_enough

# Words that count as units (fixed values).
UNITS = frozenset(
    "kg g mg lb oz km m cm mm mi ft in l ml s sec min h hr kg/h km/h mph ms gb mb kb usd eur gbp $ € £ % "
    "percent dollars euros pounds cents hours minutes seconds days weeks years meters metres kilometers "
    "kilometres miles feet inches grams kilograms liters litres degrees".split()
)
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?[%€]?")


def _bare(tok: str) -> str:
    """A token without the punctuation around it."""
    i, j = 0, len(tok)
    while i < j and not (tok[i].isalnum() or tok[i] in "_$€£%+-"):
        i += 1
    while j > i and not (tok[j - 1].isalnum() or tok[j - 1] in "_$€£%"):
        j -= 1
    return tok[i:j]


# At most so many rows to leave out are broadcast.
MAX_ROWS = 1_000_000
_NUM, _UNIT, _NAME = (np.uint64(xxhash.xxh64_intdigest(x, seed=1)) for x in ("number", "unit", "name"))


class _Words(dict):
    """Numbers of the distinct tokens of the texts so far; for each its word, hash, placeholder hash, kind."""

    def __init__(self, lower: frozenset, most: int = 200_000):
        super().__init__()
        self.lower, self.most = lower, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.words = []
        self.table = np.zeros(1024, [("raw", "u8"), ("hash", "u8"), ("kind", "i1")])

    def __missing__(self, tok: str) -> int:
        w = _bare(tok)
        low = w.lower()
        raw = hash_ = np.uint64(xxhash.xxh64_intdigest(low.encode("utf-8", "replace")))
        kind = 0
        if not any(map(str.isalnum, w)) and low not in UNITS:
            kind = -1
        elif _NUMBER.fullmatch(w):
            kind, hash_ = 1, _NUM
        elif low in UNITS:
            kind, hash_ = 2, _UNIT
        elif len(w) > 1 and w[0].isupper() and w[1:].islower() and low not in self.lower:
            kind, hash_ = 3, _NAME
        i = len(self.words)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[i] = raw, hash_, kind
        self.words.append(low)
        self[tok] = i
        return i

    def canonical(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of the words of the texts, end to end, their kinds, and the text of each."""
        if len(self) > self.most:
            self.reset()
        toks = [t.split() if t else () for t in texts]
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(toks)), np.int64)
        of = np.repeat(np.arange(len(texts)), [len(t) for t in toks])
        kind = self.table["kind"][ids]
        keep = kind >= 0  # a token without letters or digits is no word
        return ids[keep], kind[keep], of[keep]


def _windows(raw: np.ndarray, hash_: np.ndarray, kind: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every window of `width` words within one text."""
    n = len(of) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers(len(of))
    held = np.concatenate([[0], np.cumsum(kind > 0)])
    heavy = 2 * (held[width:] - held[:n]) > width
    out = np.empty(n, np.uint64)
    for some, values, seed in ((~heavy, hash_, width), (heavy, raw, width + (1 << 32))):
        if some.any():
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up)])
            out[some] = mix64((total[width:] - total[:n])[some] * down[:n][some] + np.uint64(seed))
    at = np.flatnonzero(of[:n] == of[width - 1 :])
    return out[at], at


_FOUND = "id long, pos int, hash long, slots array<struct<at:int,name:boolean,word:string>>"
_SLOTS = pa.list_(pa.struct([("at", pa.int32()), ("name", pa.bool_()), ("word", pa.string())]))


def _scan(column: str, widths, wanted, lower):
    """Windows of each row; with `wanted` (a broadcast of sorted hashes) only those among them.

    Without `lower` (a broadcast of all the benchmark's lower-case words) each row brings those that it needs, in `known`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(lower.value if lower else frozenset())
        want = None if wanted is None else np.frombuffer(wanted.value, np.uint64)
        for batch in batches:
            rows, texts = batch.column(column), batch.column("text").to_pylist()
            known = None if lower else batch.column("known").to_pylist()
            for i, j in blocks(texts, 1 << 19):
                if known is not None:  # each row's own are among them, so that what is kept of a token holds for all rows
                    words.lower = frozenset(chain.from_iterable(k for k in known[i:j] if k))
                ids, kind, of = words.canonical(texts[i:j])
                if not len(ids):
                    continue
                raw, hash_ = words.table["raw"][ids], words.table["hash"][ids]
                start = np.searchsorted(of, np.arange(j - i + 1))
                sizes = np.diff(start)
                for w in sorted({widths(n) for n in set(sizes.tolist())} - {0}) if callable(widths) else widths:
                    x, at = _windows(raw, hash_, kind, of, w)
                    if callable(widths):
                        own = np.array([widths(n) for n in sizes.tolist()])
                        x, at = x[own[of[at]] == w], at[own[of[at]] == w]
                    if want is not None:
                        k = np.searchsorted(want, x)
                        hit = want[np.minimum(k, len(want) - 1)] == x if len(want) else np.zeros(len(x), bool)
                        x, at = x[hit], at[hit]
                    for lo in range(0, len(x), 50_000):
                        some, pos = x[lo : lo + 50_000], at[lo : lo + 50_000]
                        place = pos - start[of[pos]]
                        slots = [[{"at": y, "name": bool(kind[p + y] == 3), "word": words.words[ids[p + y]]} for y in np.flatnonzero(kind[p : p + w]).tolist()] for p in pos.tolist()]
                        cols = [rows.take(pa.array(i + of[pos])), pa.array(place, pa.int32()), pa.array(some.view(np.int64)), pa.array(slots, _SLOTS)]
                        yield pa.RecordBatch.from_arrays(cols, names=["id", "pos", "hash", "slots"])

    return run


def _vocabulary(items: DataFrame) -> DataFrame:
    """w: the words that the benchmark has in lower case."""
    words = items.select(F.explode(F.split("text", r"\s+")).alias("w")).select(F.regexp_replace("w", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("w"))
    return cut(words.where("w <> '' AND w = lower(w)").distinct())


def _capitals(column: str):
    """The capitalised words of each row, in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for row, text in zip(batch.column(column).to_pylist(), batch.column("text").to_pylist(), strict=True):
                bare = map(_bare, set((text or "").split()))
                out |= {(row, w.lower()) for w in bare if len(w) > 1 and w[0].isupper() and w[1:].islower()}
            rows, words = zip(*sorted(out), strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(words, pa.string())], names=["id", "w"])

    return run


def _with_known(texts: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """`texts` (`column`, text) with `known`: which of each row's capitalised words are among `words` (w)."""
    held = texts.mapInArrow(in_parts(_capitals(column)), "id long, w string").distinct().join(words, "w")
    held = held.groupBy("id").agg(F.collect_list("w").alias("known")).withColumnRenamed("id", column)
    return texts.join(held, column, "left")


def _anchors(mine: DataFrame, sizes: DataFrame, share: float, need: int) -> DataFrame:
    """item_id, hash: windows of each item such that a share of `share` of its windows, and `need` in a row, hold one.

    These are the windows that fewest items have: so many that fewer than that share are left, and the rarest of each
    half run, since every run holds a whole one.
    """
    held = mine.groupBy("hash").agg(F.count_distinct("item_id").alias("df"))
    half = F.floor(F.col("pos") / F.lit((need + 1) // 2))
    order = ["df", "hash", "pos"]
    ranked = mine.select("item_id", "pos", "hash").join(held, "hash").join(sizes, "item_id")
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    ranked = ranked.withColumn("first", F.row_number().over(Window.partitionBy("item_id", half).orderBy(*order)) == 1)
    enough = F.col("total") - F.ceil(F.col("total") * F.lit(share)) + 1
    return ranked.where(F.col("first") | (F.col("nth") <= enough)).select("item_id", "hash").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, share: float = 0.5, words: int = 13, max_broadcast: int = 500_000, max_words: int = 2_000_000) -> DataFrame:
    """Pairs of a row of `docs` (row, text) and an item of `benchmark` (item_id, text) that it holds.

    Returns row, item_id, n_windows (distinct windows of the item that fill its slots consistently), coverage (their
    share of the item's windows), exact (whether all slots of all shared windows hold the item's own values). Where
    a slot is filled in several ways the most frequent one counts, and windows that fill it otherwise do not. A
    pair needs a coverage of `share` or more, or a run of `words` or more consecutive words of the item on one
    diagonal. An item of fewer than `width` words is one window of its own length. Null and empty texts hold and
    give nothing. Other columns are ignored, repeated items count once (of several texts under one item_id the
    smallest); rows without item_id are no items. Up to `max_broadcast` windows of the benchmark are broadcast, as a
    filter below the join and in it; more are joined by shuffle alone. Up to `max_words` lower-case words of
    the benchmark, which tell names from words, are broadcast; more are joined with the capitalised words of each row.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL")
    items = cut(items.groupBy("item_id").agg(F.min("text").alias("text")))
    sc = docs.sparkSession.sparkContext
    vocabulary, lower = _vocabulary(items), None
    told = lambda texts, column: texts if lower else _with_known(texts, column, vocabulary)
    if small_enough(vocabulary, max_words):
        lower = sc.broadcast(frozenset(vocabulary.toArrow().column("w").to_pylist()))
    ours = cut(told(items, "item_id").mapInArrow(_scan("item_id", lambda n: min(n, width), None, lower), _FOUND))
    sizes = ours.groupBy("id").agg(F.count("*").alias("total")).withColumnRenamed("id", "item_id")
    short = items.mapInArrow(_lengths(width), "n int").distinct().collect()  # at most `width` values
    widths = sorted({r.n for r in short})
    few = ours.count() <= max_broadcast
    wanted = None
    if few:
        got = np.unique(ours.select("hash").toArrow().column("hash").to_numpy().view(np.uint64))
        wanted = sc.broadcast(got.tobytes())
    none = -(2**63)  # stands for a null row in the joins below
    theirs = docs.select(F.coalesce(F.col("row").cast("long"), F.lit(none)).alias("row"), "text")
    theirs = told(theirs, "row").mapInArrow(in_parts(_scan("row", widths, wanted, lower)), _FOUND)
    theirs = theirs.dropDuplicates(["id", "pos", "hash"]).select(F.col("id").alias("row"), F.col("pos").alias("dpos"), "hash", F.col("slots").alias("dslots"))
    theirs, mine = cut(theirs), ours.withColumnRenamed("id", "item_id")
    # a run of `words` words is as many consecutive windows as start in it
    need = max(1, words - width + 1)
    # a pair that counts has one of the item's rare windows: a phrase that many items share brings no pair by itself
    rare = cut(_anchors(mine, sizes, share, need))
    near = cut(theirs.join(F.broadcast(rare) if few else rare, "hash").select("row", "item_id").distinct())
    both = theirs.join(near, "row").join(F.broadcast(mine) if few else mine, ["item_id", "hash"])
    both = cut(both.where("size(slots) = size(dslots)").drop("hash"))
    pair, window = ["row", "item_id"], ["row", "item_id", "pos", "dpos"]
    # a name stands for one value in the document; a number or unit for one at each of its places in the item
    each = both.select(*window, F.explode(F.arrays_zip("slots", "dslots")).alias("z"))
    key = F.when(F.col("z.slots.name"), F.concat(F.lit("="), "z.slots.word")).otherwise((F.col("pos") + F.col("z.slots.at")).cast("string"))
    each = each.select(*window, key.alias("key"), F.col("z.slots.word").alias("own"), F.col("z.dslots.word").alias("value"))
    votes = each.groupBy(*pair, "key", "value").agg(F.count("*").alias("n"), F.max(F.col("own") == F.col("value")).alias("same"))
    best = votes.groupBy(*pair, "key").agg(F.max_by("value", F.struct("n", "same", "value")).alias("best"), F.min("same").alias("same"))
    best = cut(best)
    odd = each.join(best, [*pair, "key"]).where("value <> best").select(*window).distinct()
    good = cut(both.select(*window).join(odd, window, "left_anti"))
    along = Window.partitionBy(*pair, F.col("pos") - F.col("dpos")).orderBy("pos")
    runs = good.withColumn("gap", F.col("pos") - F.row_number().over(along))
    runs = runs.groupBy(*pair, (F.col("pos") - F.col("dpos")).alias("diag"), "gap").agg(F.count("*").alias("n")).groupBy(*pair).agg(F.max("n").alias("run"))
    found = good.select(*pair, "pos").distinct().groupBy(*pair).agg(F.count("*").alias("n_windows")).join(sizes, "item_id").join(runs, pair)
    exact = best.groupBy(*pair).agg(F.min("same").alias("exact"))
    found = found.join(exact, pair, "left").withColumn("coverage", F.col("n_windows") / F.col("total"))
    found = found.where((F.col("coverage") >= share) | (F.col("run") >= need))
    found = found.withColumn("row", F.nullif("row", F.lit(none)))
    out = cut(found.select(*pair, "n_windows", "coverage", F.coalesce("exact", F.lit(True)).alias("exact")))
    drop(items, vocabulary, ours, theirs, rare, near, both, best, good)
    return out


def _lengths(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(frozenset())  # names count as words do
        for batch in batches:
            texts = batch.column("text").to_pylist()
            _, _, of = words.canonical(texts)
            n = np.unique(np.minimum(np.bincount(of, minlength=1), width))
            yield pa.RecordBatch.from_arrays([pa.array(n[n > 0], pa.int32())], names=["n"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """`docs` (any columns, text among them) without the rows that hold a benchmark item; repeated rows fare alike.

    A row is told by a hash of its text, so texts are neither stored nor numbered: equal texts hold the same items.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__doc"), F.xxhash64("text").alias("__row"))
    bad = contaminated(docs.select(F.xxhash64("text").alias("row"), "text"), benchmark, **how)
    bad = cut(bad.select(F.col("row").alias("__row")).distinct())
    # up to a checked number of rows (8 bytes each) is broadcast, so that texts are shuffled only beyond it
    return rows.join(maybe_broadcast(bad, MAX_ROWS), "__row", "left_anti").select("__doc.*")
