import random
import re

import pytest

from sealedspark.llm import sentences

WORD = re.compile(r"[^ \t\n\v\f\r]+")


def low(w):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


def plain_sentences(text):
    """(first word, word after the last) of the sentences, and the words, by string operations alone."""
    found = list(WORD.finditer(text or ""))
    out, start = [], 0
    for i, m in enumerate(found):
        w = m[0]
        if len(w) > 1 and w[-1] in "\"')]}":
            w = w[:-1]
        gap = text[m.end() : found[i + 1].start()] if i + 1 < len(found) else "\n\n"
        if w[-1] in ".!?" or gap.count("\n") >= 2:
            out.append((start, i + 1))
            start = i + 1
    return out, [low(m[0]) for m in found], found


def runs(text, n):
    """(start, end) of the sentence runs of n words or more, one from each sentence on."""
    s, words, _ = plain_sentences(text)
    return [(a, next(e for _, e in s if e - a >= n)) for a, _ in s if len(words) - a >= n]


def by_brute_force(rows, n):
    """What sentence runs alone remove: the text without the words that a later equal run covers."""
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        s, words, found = plain_sentences(t)
        off = set()
        for a, e in runs(t, n):
            own = first.setdefault(tuple(words[a:e]), (i, a, e))
            if own[0] != i:
                off |= set(range(a, e))
            elif own[1] != a:
                off |= set(range(max(a, own[2]), e))
        out[i] = (len(s), sum(any(w in off for w in range(a, e)) for a, e in s), [m[0] for k, m in enumerate(found) if k not in off])
    return out


def test_equals_brute_force_on_sentence_runs(spark, monkeypatch):
    monkeypatch.setattr(sentences, "PASSAGE", 10**6)  # no windows: sentence runs alone
    rnd = random.Random(5)
    bank = [" ".join(f"W{rnd.randrange(9)}" for _ in range(rnd.randint(1, 9))) + rnd.choice([".", "!", '?"', "."]) for _ in range(25)]
    rows = [(i, "".join(rnd.choice(bank) + rnd.choice([" ", "  ", "\n", "\n\n"]) for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    rows += [(90, None), (91, ""), (92, " \n"), (93, "no end at all " * 9), (94, "NO end AT all " * 9), (95, "One. " * 60), (96, "One. " * 60)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, order int")
    want = by_brute_force(rows, 12)
    got = {r.doc_id: r for r in sentences.dedup(df, words=12).collect()}
    assert len(got) == len(rows) and got[90].text is None and (got[90].n_sentences, got[90].n_removed) == (0, 0)
    for i, w in want.items():
        assert (got[i].n_sentences, got[i].n_removed, WORD.findall(got[i].text)) == w, i
    assert sum(w[1] for w in want.values()) > 50
    assert sentences.dedup(df.limit(0)).count() == 0


def test_passages_wherever_their_sentences_end(spark):
    rnd = random.Random(8)
    some = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    one, two, inner, bare, lines = some(60) + ".", some(30) + ". " + some(30) + ".", some(55), some(70), "\n".join(some(6) for _ in range(12))
    texts = [f"{some(9)}. {one} {two} {some(20)} {inner} {some(20)}. {bare} {some(9)} {lines}"]
    texts += [f"{some(8)}. {x} {some(8)}." for x in (one, two)] + [f"{some(30)} {inner} {some(30)}.", f"{some(5)} {bare} {some(6)}", f"{some(4)}. {lines.replace(chr(10), ' ')} {some(9)}"]
    short = f"{some(15)}. {some(12)}."
    texts += [f"{some(30)}. {short} {some(30)}.", f"{some(30)}. {short} {some(30)}.", "la " * 400, some(100_000), "Des. Des. Des. Des."] + ["Des. Des. Des. Des."]
    df = spark.createDataFrame([(None, texts[0]), *enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in sentences.dedup(df).collect()}
    assert all(got[i].text == texts[i] and got[i].n_removed == 0 for i in (0, 6, 7, 9, 10, 11)), "first ones, short repeats"
    for i, x in ((1, one), (2, two), (3, inner), (4, bare), (5, lines)):
        held, own = set(x.split()), [w for w in texts[i].split() if w not in x.split()]
        left = got[i].text.split()
        assert [w for w in left if w not in held] == own and len(left) - len(own) <= len(held) - 30 and got[i].n_removed > 0
    assert set(got[8].text.split()) == {"la"} and len(got[8].text.split()) <= 50
    assert got[None].n_removed > 0 and len(got[None].text) < len(texts[0]) / 2


def test_repeated_rows_fare_alike(spark):
    text = " ".join(f"w{i}" for i in range(80)) + "."
    df = spark.createDataFrame([(5, text), (5, text), (7, text), (7, text), (5, "x " + text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, len(r.text.split())) for r in sentences.dedup(df).collect())
    fives = [g for g in got if g[0] == 5]
    assert [g for g in got if g[0] == 7] == [(7, 1, 0)] * 2 and sorted(g[2] > 60 for g in fives) in ([False, True, True], [False, False, True])


@pytest.mark.parametrize("texts", [[None], [""], ["   "], ["a"], ["a.", None, "b c."]])
def test_no_spans_in_short_texts(texts):
    assert all(len(x) == 0 for x in sentences.spans(texts, 40))


def test_words_that_collide_under_polynomials_erase_nothing(spark):
    def word(a, b):
        return "".join(b if bin(i).count("1") % 2 else a for i in range(1024))

    pairs = ["ab", "cd", "ef", "gh"]
    one, two = (" ".join([word(*(p if k else p[::-1])) for p in pairs] * 10) + "." for k in (0, 1))
    df = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in sentences.dedup(df).collect()}
    assert got == {1: one, 2: two, 3: ""}
