import random
import re

import pytest

from sealedspark.llm import common, minhash
from sealedspark.llm.graph import components


def brute(rows, k, percent):
    """Components over all pairs, by plain sets of strings."""
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    comp = {i: i for i, _ in rows}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for x, (i, _) in enumerate(rows):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * len(sets[x] | sets[y]):
                a, b = root(i), root(rows[y][0])
                comp[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for (i, _), s in zip(rows, sets)}


@pytest.mark.parametrize("k", [2, 5])
def test_equals_brute_force(spark, k):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "two one")]
    base = [rnd.choices(vocab, k=rnd.randint(20, 90)) for _ in range(12)]
    for i in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, max(1, len(w) // 18))):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((1000 - i, (rnd.choice([" ", "\n", "  "])).join(w)))
    rows += [(i, " ".join(rnd.choices(vocab, k=30))) for i in range(2000, 2040)]
    rows.append((5000, " ".join(rnd.choices(vocab, k=60_000))))
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, n string, fp double")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, words=k).collect()}
    assert got == brute(rows, k, 80)


@pytest.mark.parametrize("k", [2, 5])
def test_large_groups_equal_brute_force(spark, k):
    """A group of near copies around the threshold, some linked and some not, and unlinked documents in one bucket."""
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    base, shared = rnd.sample(vocab, 120), rnd.sample(vocab, 120)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 22)):
            at = rnd.randrange(len(w))
            w[at : at + 1] = rnd.choice([[], [rnd.choice(vocab)], [w[at], rnd.choice(vocab)]])
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(shared + rnd.choices(vocab, k=rnd.randint(40, 70)))) for i in range(200)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=k).collect()}
    want = brute(rows, k, 80)
    assert got == want
    assert len({c for i, (_, c) in want.items() if i < 1000}) > 5 and all(c == i for i, (_, c) in want.items() if i >= 1000)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, None), (3, "a b c"), (3, "a b c"), (9, "A  B\tC")], "doc_id long, text string")
    got = sorted(minhash.near_duplicates(df, words=2).collect(), key=str)
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got] == [
        (3, 2, 3, True), (3, 2, 3, True), (9, 2, 3, False), (None, 0, None, True), (None, 2, None, True)]
    kept = minhash.keep_one(df, words=2).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("3", "a b c"), ("None", "None"), ("None", "a b c")]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_word_hashes_of_long_texts_and_white_space():
    """A word has one hash wherever it stands, in texts of many parts too."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(50)] + ["x" * 300_000, "\u6f22"]
    texts = [None, "", " " * 700_000, "w1 " * 200_000, "w2" + " " * 900_000, " " * 600_000 + "W3", " ".join(rnd.choices(words, k=40)), "w4\n"]
    alone = {w: int(common.word_hashes([w])[0][0]) for w in words}
    h, bounds = common.word_hashes(texts)
    assert [h[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[alone[w.lower()] for w in (t or "").split()] for t in texts]
    assert len(set(alone.values())) == len(words)
    assert [len(x) for x in common.word_hashes([])] == [0, 1] and len(common.word_hashes([" " * 600_000])[0]) == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 70), (70, 100), (200, 201), (5, 5)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {70: 70, 100: 70, 200: 200, 201: 200}


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_collide_under_polynomials_link_nothing(spark):
    """Complementary Thue-Morse words have one polynomial hash modulo 2**64 whatever the base."""
    one, two = thue_morse(1024), thue_morse(1024, "b", "a")
    some = [thue_morse(1024, *p) for p in ("cd", "ef", "gh", "ij")], [thue_morse(1024, *p) for p in ("dc", "fe", "hg", "ji")]
    rows = [(1, one), (2, two), (3, " ".join(some[0] * 10)), (4, " ".join(some[1] * 10)), (5, one.upper())]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    assert len({int(common.word_hashes([w])[0][0]) for w in (one, two, *some[0], *some[1])}) == 10


def test_classes_hold_equal_words_only(spark):
    """Texts of one set of shingles in another order are linked by comparison, and clashing columns do not matter."""
    rows = [(3, "A b  c", "x", 1), (1, "a B\nc", "x", 1), (2, "b c a b", "x", 1), (4, "a b c a b", "x", 1), (5, "c a b c a", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, rep int")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.near_duplicates(df, words=2).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 3), 4: (2, 3), 5: (2, 3)}
