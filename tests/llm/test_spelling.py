import random
import re
import zlib
from collections import Counter

import pytest
from oracle import compare

from sealedspark.llm import queries, spelling

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(docs):
    n = Counter()
    for i, t in docs:
        for w in RUN.findall(t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n, ratio=10):
    out = {}
    for w in n:
        others = [v for v in n if v != w and near(v, w)]
        best = min(others, key=lambda v: (-n[v], v)) if others else None
        out[w] = (len(others), best if best is not None and n[best] >= ratio * n[w] else None)
    rows = set()
    for w, (k, form) in out.items():
        root = w
        while out[root][1] is not None:
            root = out[root][1]
        rows.add((w, form, root, n[w], k, n[form] if form is not None else None))
    return rows


def got(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_counts_equal_brute_force(spark):
    rnd = random.Random(5)
    words = ["strasse", "Straße", "ÄPFELCHEN", "äpfelchen", "information", "informatio", "Bücherei", "kurz", "x" * 60, "naïveté", "ÿÿÿÿÿÿÿÿ"]
    docs = [(rnd.choice([None, *range(40)]), " ".join(rnd.choice(words) + rnd.choice(["", ".", "\n", "×", "1"]) for _ in range(rnd.randint(0, 60)))) for _ in range(80)]
    docs += [(1, None), (2, ""), (3, "information"), (3, "information"), (4, "abcdefghij" * 20_000), (5, "abcdefghij" * 20_000)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    assert {r.word: r.n for r in spelling.count_words(df).collect()} == plain_counts(docs)
    assert spelling.count_words(df.limit(0)).count() == 0


def test_groups_equal_brute_force(spark):
    rnd = random.Random(7)
    n = {}
    for _ in range(150):
        w = "".join(rnd.choice("abß") for _ in range(rnd.randint(1, 5)))
        n[w] = 10 ** rnd.randint(0, 6) * rnd.randint(1, 3)
    n |= {"": 3, "aaaa": 5, "aaaaa": 500, "aaaaaa": 50_000, "aaaaaaa": 5_000_000, "\U0001f600a": 4, "a": 40, "\U0001f601a": 40, "long" * 50_000: 2, "long" * 49_999 + "lon": 20, "Long" + "long" * 49_999: 20}
    df = spark.createDataFrame([(w, c, "f", 1) for w, c in n.items()] + [(None, 3, "f", 1), ("lost", None, "f", 1)], "word string, n long, form string, id int")
    short = {w: c for w, c in n.items() if len(w) < 100}
    want = plain_groups(short)
    found = got(spelling.group_variants(df))
    assert {r for r in found if len(r[0]) < 100} == want
    big = {r[0]: r for r in found if len(r[0]) >= 100}
    assert big["long" * 50_000][4] == 2 and big["long" * 50_000][1] == "Long" + "long" * 49_999 and len(big) == 3
    assert len(found) == len(n)


def test_colliding_keys_link_nothing(spark, monkeypatch):
    n = {"abcdefg": 1000, "abcdefx": 10, "bcdefgh": 90, "qrstuvw": 3, "bcdefg": 2}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    monkeypatch.setattr(spelling, "_BASES", (0, 0))  # a key is a word's last letter then; workers get it with the function
    keys = spelling._keys_of
    assert len(set(keys.__globals__["_BASES"])) == 1
    assert got(spelling.group_variants(df)) == plain_groups(n)


def test_keys_are_those_of_the_deleted_strings():
    import numpy as np

    def key(w):
        return spelling._keys_of(np.array([[ord(c) + 1 for c in w]], np.uint64))[0]

    for w in ("abcabc", "aab", "zyxw", "ab"):
        assert [k for k in key(w)[1:]] == [key(w[:i] + w[i + 1 :])[0] for i in range(len(w))]


def test_a_chain_of_forms_and_ties(spark):
    n = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "zaaaaaa": 10, "aaaaaa": 1}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(spelling.group_variants(df)) == plain_groups(n)
    with pytest.raises(ValueError):
        spelling.group_variants(df, ratio=1)


def test_oracle(spark):
    compare(spark, queries.op12_spelling_variants, queries.oracle_sql()["op12_spelling_variants"], SF)
