import base64
import hashlib

import public_tokenizers as P
import tiktoken

from sealedspark.llm import bpe, common

PATH = P.path("byte_bpe_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_tiktoken(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs]
    rows += [(10001, None), (10002, ""), (10003, " " * 5000), (10004, "a" * 20_000 + "é" * 999), (10005, "<|endoftext|> it's  x"), (None, "\U0001f600 don't"), (1, "twice")]
    df = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, ids binary")
    enc = reference()
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((str(i), len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(str(r[0]), *r[1:]) for r in bpe.digests(bpe.encode_documents(df, PATH, P.PATTERN)).collect()]
    assert sorted(got) == sorted(want)
    assert bpe.encode_documents(df.limit(0), PATH, P.PATTERN).count() == 0


def test_leftmost_of_equal_ranks():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaaa": 257}
    assert bpe.merge_piece(b"aaaaa", ranks) == [257, 97]
    assert bpe.merge_piece(b"aaa", ranks) == [256, 97]


def test_another_operator_frees_the_codec():
    codec = bpe._codec("x", b"YQ== 0", "a+")
    list(common.in_parts(lambda parts: parts, keeps="bpe")([]))
    assert bpe._codec("x", b"YQ== 0", "a+") is codec is not bpe._codec("y", b"YQ== 0", "a+")
    list(common.in_parts(lambda parts: parts)([]))
    assert not common.HELD
