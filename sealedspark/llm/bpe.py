"""Byte-level BPE from a file of merge ranks, with a segment tree over byte positions.

Leaf i of the tree holds the rank of the pair that starts at byte i (or none); a node holds the smallest rank
below it, the leftmost one where ranks tie. A merge reads the root, joins two live neighbours and rewrites the
leaves of the merged part, its right neighbour and its left neighbour: three walks to the root. So one piece of
n bytes takes O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealedspark.layout import spread
from sealedspark.llm.common import HELD, in_parts

NONE = 1 << 60


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the lowest-ranked pair first, the leftmost where ranks tie."""
    n = len(piece)
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if n == 1:
        raise ValueError(f"the vocabulary has no byte {piece!r}")
    size = 1 << (n - 1).bit_length()
    get = ranks.get
    # 8 bytes a number in a long piece (about 48 bytes for each of its bytes); lists of objects are faster in short ones
    numbers = list if n < 4096 else partial(array, "q")
    # A key is rank * size + position, so that the smallest key is the leftmost smallest rank.
    tree = numbers([NONE]) * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = numbers(range(1, n + 1))  # end of the live part that starts at i
    before = numbers(range(-1, n))  # start of the live part before the one at i
    while (top := tree[1]) < NONE:
        i = top & (size - 1)
        j = end[i]
        stop = end[i] = end[j]
        if stop < n:
            before[stop] = i
            r = get(piece[i : end[stop]])
        else:
            r = None
        changed = [(i, NONE if r is None else r * size + i), (j, NONE)]
        if (h := before[i]) >= 0:
            r = get(piece[h:stop])
            changed.append((h, NONE if r is None else r * size + h))
        for at, key in changed:
            k = size + at
            tree[k] = key
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                m = a if a < b else b
                if tree[k] == m:
                    break
                tree[k] = m
                k >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Codec:
    """Encodes texts by a rank file and a pattern and decodes ids; keeps up to `most` encoded pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 400_000):
        self.ranks, self.most = ranks, most
        self.find = regex.compile(pattern).findall
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, i in ranks.items():
            self.token[i] = piece
        self.known: dict[str, bytes] = {}

    def __missing_piece(self, piece: str) -> bytes:
        ids = merge_piece(piece.encode("utf-8", "replace"), self.ranks)
        got = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(piece) <= 64:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[piece] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; none for a null or empty text."""
        if not text:
            return b""
        pieces = self.find(text)
        got = list(map(self.known.get, pieces))
        if None in got:
            look, miss = self.known.get, self.__missing_piece
            got = [look(p) or miss(p) for p in pieces]
        return b"".join(got)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


def _codec(path: str, blob: bytes, pattern: str) -> Codec:
    """The codec of a rank file, kept in the worker for the next task until another operator's task begins there."""
    if (held := HELD.get("bpe")) and held[0] == (path, blob, pattern):
        return held[1]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}
    HELD["bpe"] = (path, blob, pattern), Codec(ranks, pattern)
    return HELD["bpe"][1]


_OUT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("decoded_sha256", T.StringType()),
])


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every text of `docs` (doc_id, text; other columns are ignored) and decode its ids again.

    `path` names a file of base64 tokens and ranks that the driver reads (under 1 MB, so it is broadcast);
    each match of `pattern` is encoded by itself, without special tokens. Returns per row: doc_id, n_tokens,
    ids (little-endian unsigned 32-bit integers), decoded_sha256 (hex digest of the decoded bytes). A null
    or empty text has no tokens. Repeated rows and null doc_ids give a row each.
    """
    with open(path, "rb") as f:
        blob = f.read()
    if len(blob) > 8 << 20:
        raise ValueError("a rank file has at most 8 MB")
    shared = docs.sparkSession.sparkContext.broadcast(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, shared.value, pattern)
        for batch in batches:
            ids = [codec.encode(t) for t in batch.column("text").to_pylist()]
            out = [
                batch.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array(ids, pa.binary()),
                pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(out, names=_OUT.names)

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(in_parts(run, keeps="bpe"), _OUT)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what `encode_documents` returns."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")
