"""The corpus pipeline end to end against plain Python, and its stages on odd input."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_minhash import brute
from test_quality import plain_model, plain_perplexity, plain_threshold

import corpus_pipeline
from sealedspark.llm import common

ITEM = "a farmer sold 14 eggs on monday and 9 eggs on friday so how many eggs were sold in that week altogether"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, plan string, spans int"


def tokens():
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def corpus():
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in ("der", "haus", "licht", "baum", "ernte", "markt", "stein") for b in ("", "en", "ung", "er", "lich")]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    rows = [(i, text(rnd.randint(30, 70)), "de") for i in range(60)]
    rows += [(100 + i, " ".join(w if j else "neu" for j, w in enumerate(rows[i][1].split())), "de") for i in range(5)]  # near copies
    rows += [(200, rows[7][1], "de"), (201, text(20) + " " + ITEM.replace("14", "31") + " " + text(20), "de"), (202, text(300) + " password = hunter2hunter2 " + text(90), "de")]
    rows += [(203, "zqxj wvkp " * 20, "de"), (204, None, "de"), (205, "", None), (None, text(25), None), (None, None, None), (9, rows[9][1], "de"), (206, text(20_000), "de")]
    return [(i, t, lang, "s", len(t or ""), "clash", 1) for i, t, lang in rows]


def write(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def by_brute_force(rows, trusted, held):
    """doc_id, n_tokens and digest of the decoded text of every row that stays."""
    p = plain_model([t for i, t, *_ in rows if i in trusted - held and t])
    limit = plain_threshold([plain_perplexity(p, t) for i, t, *_ in rows if i in held and t])
    rows = [r for r in rows if not r[1] or plain_perplexity(p, r[1]) <= limit]
    comp = brute([(i, t) for i, t, *_ in {(r[0], r[1]) for r in rows if r[0] is not None}], 5, 80)
    rows = [r for r in rows if r[0] is None] + list({r[0]: r for r in rows if r[0] is not None and comp[r[0]][1] == r[0]}.values())
    words = lambda t: [re.sub(r"\d+", "#", w) for w in (t or "").split()]
    item = words(ITEM)
    rows = [r for r in rows if not any(x[k : k + len(item)] == item for x in [words(r[1])] for k in range(len(x)))]
    enc, out = tokens(), []
    for i, t, *_ in rows:
        t = re.sub(r"password = [A-Za-z0-9]{8,}", "[secret]", t) if t else ""
        out.append((str(i), len(enc.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_run_equals_brute_force(spark, tmp_path):
    rows = corpus()
    trusted = set(range(55))
    where = write(spark, tmp_path, rows, [(i, 1, 0) for i in trusted] + [(203, 0, 0)], [(1, ITEM), (None, "x"), (2, None)])
    held = {r.i for r in spark.createDataFrame([(i,) for i in trusted], "i long").where(F.pmod(F.xxhash64("i"), F.lit(5)) == 0).collect()}
    want = by_brute_force(rows, trusted, held)
    got = sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, where).collect())
    assert got == want
    ids = {g[0] for g in got}
    assert not ids & {"100", "200", "201", "203"} and {"None", "0", "202", "204", "205"} <= ids
    common.sweep()


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None, None)] * 2])
def test_empty_tables(spark, tmp_path, rows):
    where = write(spark, tmp_path, rows, [], [])
    assert corpus_pipeline.run(spark, where).count() == len(rows)


def test_stages_keep_the_columns(spark, tmp_path):
    where = write(spark, tmp_path, corpus(), [], [])
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, where).dtypes == docs.dtypes
    left = {r.doc_id: (r.text, r.n_chars, r.plan, r.spans) for r in corpus_pipeline.no_secrets(spark, docs, where).collect()}
    assert "[secret]" in left[202][0] and left[202][1:] == (len(left[202][0]), "clash", 1)
