import math
import random
import re
import zlib
from collections import Counter

import pytest
from oracle import compare
from pyspark.sql import functions as F

from sealedspark.llm import queries, rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, held string, words string, row int, score int"


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    many = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if many[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def plain(rows, good, buckets, quantile=0.01, slack=1.5):
    """score by row and the threshold, by dictionaries."""
    held = {i for i in good if zlib.crc32(str(i).encode()) % 5 == 0}

    def feats(t):
        w = WORD.findall(t or "")
        return [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    raw, own = Counter(), Counter()
    for i, t in rows:
        raw.update(feats(t))
        if i in good - held:
            own.update(feats(t))
    n, m = sum(raw.values()), sum(own.values())
    weight = {}
    for b, c in raw.items():
        p = (c + 1) / float(n + buckets)
        weight[b] = math.floor(math.log(((own[b] + buckets * p) / float(m + buckets)) / p) * 1e6)
    scores = [sum(weight[b] for b in f) / len(f) if (f := feats(t)) else None for _, t in rows]
    bins = sorted(s // 100 for (i, t), s in zip(rows, scores, strict=True) if i in held and s is not None and not base(t)[-1])
    if not bins:
        return scores, None
    at = lambda q: bins[max(0, math.ceil(q * len(bins)) - 1)] * 100.0
    return scores, at(0.5) - slack * (at(0.5) - at(quantile))


def sample():
    words = ["der", "die", "und", "haus", "Ähre", "ist", "gut", "42", "the", "of", "\U0001f600"]
    rnd = random.Random(11)
    rows = [(i, " ".join(rnd.choice(words) + rnd.choice(["", "", "n", "en", "."]) for _ in range(60 + i))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n\x0b\x0c\r "), (103, "### $$$ %%% " * 30), (104, "a b c a b c d e f"), (None, rows[3][1]), (5, rows[5][1]), (5, rows[5][1])]
    rows += [(105, "x\ny\nx\n\n \n x\nx\r\nx"), (106, "a b c d " * 20), (107, "der baum ist gut " * 20_000), (108, " ".join(f"w{i}" for i in range(50_000))), (109, "a a a a"), (110, "a b\na b c")]
    return rows


def test_equals_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(i, t, "h", "w", 1, 2) for i, t in rows], SCHEMA)
    good = {i for i in range(50)} - {3, 4} | {100}
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(3, 0, 0), (4, 1, 1), (None, 1, 0), (100, 1, 0)], "doc_id long, quality int, toxic int")
    got = rules.judge(docs, labels, buckets=512).collect()
    scores, limit = plain(rows, good, 512)
    assert limit is not None and len(got) == len(rows) and all(math.isclose(r.threshold, limit) for r in got)
    want = []
    for (i, t), s in zip(rows, scores, strict=True):
        b = base(t)
        want.append((str(i), *b, None if s is None else round(s, 6), not b[-1] and (s is None or s >= limit)))
    found = [(str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, None if r.score is None else round(r.score, 6), r.kept) for r in got]
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_windows_of_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(rules.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    docs = spark.createDataFrame([(1, "a b c d e a b c"), (2, "a b c d e f g"), (3, "a a a a a")], "doc_id long, text string")
    assert [r.n_repeat_words for r in rules.base_counts(docs).orderBy("doc_id").collect()] == [6, 0, 5]


def test_no_documents_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b " * 40), (2, " ".join(map(str, range(80))))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rules.judge(docs.limit(0), none).count() == 0
    got = {r.doc_id: r for r in rules.judge(docs, none).collect()}
    assert got[1].base_failed and not got[1].kept and got[2].kept and got[2].threshold is None


def test_junk_goes_and_clean_stays(spark):
    """At sf0.01: what the base rules pass and labels call bad is rejected, what they call good stays."""
    sf = "/root/testdata/sf0.01"
    got = queries.op11_quality_rules(spark, sf).where("NOT base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {r.quality: (r.n, r.kept) for r in got.groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()}
    assert n[1][1] >= 0.98 * n[1][0] and n[0][1] <= 0.1 * n[0][0]


def test_oracle_and_no_python(spark):
    compare(spark, queries.op11_quality_rules, queries.oracle_sql()["op11_quality_rules"], SF)
    plan = queries.op11_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("most", [0, 10])
def test_many_trusted_ids_are_joined_by_shuffle(spark, monkeypatch, most):
    docs = spark.createDataFrame(sample()[:60], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    want = sorted(map(str, rules.judge(docs, labels, 512).collect()))
    monkeypatch.setattr(rules, "MAX_TRUSTED", most)
    assert sorted(map(str, rules.judge(docs, labels, 512).collect())) == want
