"""What the training-data operators share: cutting lineage, reading tables, hashing words in numpy.

`cut` writes a table below ``spark.checkpoint.dir``, the folder that driver and executors share, so that
a lost executor costs at most the tasks it was running. Only a local master may go without that setting.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import re
import tempfile
import uuid
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_KEPT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a temporary one only in local mode, where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="sealedspark-")
    return _LOCAL["dir"]


def cut(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: its lineage ends there.

    Operators drop what nothing reads any more; what a returned DataFrame still reads goes with `sweep`.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    if not _KEPT:
        atexit.register(sweep)
    _KEPT[path] = df.sparkSession
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _KEPT.pop(path, None)


def sweep() -> None:
    """Delete every table of `cut` that is left: once results are written, and when the driver ends."""
    for path, spark in list(_KEPT.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before
            _KEPT.pop(path, None)


def drop(*dfs: DataFrame) -> None:
    """Delete tables made by `cut` that nothing reads any more."""
    for df in dfs:
        if path := getattr(df, "_cut_path", None):
            _delete(df.sparkSession, path)


# What an operator keeps in a worker from task to task, by its name.
HELD: dict[str, object] = {}


def in_parts(run, column: str = "text", most: int = 1 << 20, keeps: str = ""):
    """`run`, a function of Arrow batches, over parts of them that hold about `most` bytes of a text column.

    A batch of Spark's has a number of rows, however long these are. What a task makes of it (Python strings, joined
    bytes, hashes) is bounded by the part, or by the longest text. `column` may name a field of a struct: doc.text.
    Arrow's pool keeps what it once took; it is given back when a task ends, since workers serve many. What another
    operator than `keeps` has in HELD is let go when a task begins.
    """

    def go(batches):
        _let_go(keeps)
        try:
            yield from run(part for batch in batches for part in _parts(batch, column, most))
        finally:
            pa.default_memory_pool().release_unused()
            _give_back()

    return go


def _let_go(keeps: str) -> None:
    for name in set(HELD) - {keeps}:
        del HELD[name]


def _give_back() -> None:
    """Let the C library return freed memory of the finished task to the system, where it knows how to."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _parts(batch: pa.RecordBatch, column: str, most: int):
    head, _, field = column.partition(".")
    texts = batch.column(head)
    size = pc.binary_length(pc.struct_field(texts, field) if field else texts).fill_null(0).to_numpy()
    part = np.cumsum(size + 16) // most  # rows without a text take room too
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for i, j in pairwise(cuts):
        if i < j:
            yield batch.slice(i, j - i)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of finished stages whose DataFrames are gone (it acts on JVM garbage)."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True if `df` holds at most `max_rows` rows, the documented bound for broadcasting it."""
    return df.count() <= max_rows  # a limit would gather its rows in one task


def maybe_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """`df` with a broadcast hint where its row count is within the bound, else as it is (a shuffle join)."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


# Multipliers of the murmur3 finalisers (fixed values).
_M64 = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_M32 = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with full avalanche."""
    s = np.uint64(33)
    x = x ^ (x >> s)
    x *= _M64[0]
    x ^= x >> s
    x *= _M64[1]
    x ^= x >> s
    return x


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers with full avalanche."""
    x = x ^ (x >> np.uint32(16))
    x *= _M32[0]
    x ^= x >> np.uint32(13)
    x *= _M32[1]
    x ^= x >> np.uint32(16)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of 0 to 8 bytes
_LONG = 512  # longer words are hashed each by itself
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept per worker."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inv = pow(_BASE, -1, 1 << 64)
        steps = [np.full(size, b, np.uint64) for b in (_BASE, inv)]
        for s in steps:
            s[0] = 1
        _POWERS[:] = [np.multiply.accumulate(s) for s in steps]
    return _POWERS[0][:n], _POWERS[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, end to end, and where each text's words begin (one longer).

    Words are runs without space or control white space (0x09-0x0D), A-Z lower-cased; None counts as empty. A word is
    mixed eight bytes at a time, each step a bijection of what came before, so that words of some structure (as those
    that collide under any polynomial modulo 2**64) are told apart like others; long ones get a cryptographic hash.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    joined = (b" ".join(raw) + b" ").translate(_LOWER)
    size = len(joined)
    data = np.frombuffer(joined + bytes(8), np.uint8)
    del raw, joined
    edge = np.diff(_SPACE[data[:size]].view(np.int8), prepend=1, append=1)
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    del edge
    begin = np.zeros(len(lens) + 1, np.int64)
    begin[1:] = np.cumsum(lens + 1)
    bounds = np.searchsorted(starts, begin)
    n = stops - starts
    eights = np.ndarray((size + 1,), np.uint64, data, strides=(1,))  # the eight bytes from each place on
    out = mix64(n.astype(np.uint64) * np.uint64(_BASE))
    own = np.flatnonzero(n <= _LONG)
    step = 0
    while len(own):
        left = n[own] - step
        out[own] = mix64(out[own] * np.uint64(_BASE) ^ (eights[starts[own] + step] & _LEFT[np.minimum(left, 8)]))
        own, step = own[left > 8], step + 8
    for i in np.flatnonzero(n > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : stops[i]], digest_size=8).digest(), "little")
    return out, bounds


def word_digest(text: str) -> bytes:
    """The SHA-256 of a text's words as `word_hashes` takes them, one space apart."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at the same six characters
    return hashlib.sha256(b" ".join(words)).digest()


def shingle_hashes(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles, with repeats, end to end, and where each text's begin.

    A text with 1 to k-1 words has one shingle, its whole sequence; one without words has none.
    """
    h, bounds = word_hashes(texts)
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    pos = np.arange(out_bounds[-1]) + np.repeat(bounds[:-1] - out_bounds[:-1], count)
    left = np.repeat(np.minimum(n, k), count)
    acc = left.astype(np.uint64)
    step = np.uint64(0xD6E8FEB86659FD93)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for j in range(k):
        acc = np.where(left > j, mix64(acc * step + padded[pos + j]), acc)
    return acc, out_bounds


def blocks(texts: list[str | None], most: int = 1 << 20):
    """Ranges of consecutive texts of about `most` characters together (one text at least)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 1
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


WORD = re.compile(r"[^\x20\x09-\x0d]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None, k: int) -> set:
    """The exact set of k-word shingles of a text, as tuples of words."""
    words = WORD.findall(text.translate(ASCII_LOWER)) if text else []
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def crc32_sql(strings: str) -> str:
    """DuckDB table expressions that end in crcs(s, crc): the unsigned crc32 of the UTF-8 of `strings`, a query of one column."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END"
    byte = "('0x' || substr(h, (2 * i + 1)::INT, 2))::UBIGINT"
    return f"""crc_table AS (SELECT list(list_reduce(range(8)::UBIGINT[], lambda c, k: {step}, b::UBIGINT) ORDER BY b) AS t FROM range(256) r(b)),
crc_hex AS (SELECT s, hex(encode(s)) AS h FROM ({strings}) q(s) WHERE s IS NOT NULL),
crcs AS (SELECT s, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: {byte}),
  lambda c, x: xor(t[(xor(c, x) & 255::UBIGINT)::INT + 1], c >> 8), 4294967295::UBIGINT), 4294967295::UBIGINT) AS crc FROM crc_hex, crc_table)"""
