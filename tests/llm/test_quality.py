import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sealedspark.llm import quality

START = "\x02\x02\x02"


def clean(text):
    return "".join("0" if c.isdigit() and c.isascii() else " " if c <= " " or c == "\xa0" else c if ord(c) < 65536 else "�" for c in text)


def plain_model(texts):
    """Interpolated modified Kneser-Ney over character 4-grams by dictionaries: a function from a 4-gram to its probability."""
    counts = {4: Counter()}
    for t in texts:
        t = START + clean(t)
        counts[4].update(t[i : i + 4] for i in range(len(t) - 3))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    floor = 1 / (len(counts[1]) + 1)
    cut = {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        if n1 and n2 and n3 and n4:
            y = n1 / (n1 + 2 * n2)
            d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
            cut[n] = [min(max(x, 0.05), k + 1 - 0.05) for k, x in enumerate(d)]
        else:
            cut[n] = [0.5, 0.75, 0.9]
    total, lost = defaultdict(int), defaultdict(float)
    for n, c in counts.items():
        for g, v in c.items():
            total[n, g[:-1]] += v
            lost[n, g[:-1]] += cut[n][min(v, 3) - 1]

    def p(g):
        n = len(g)
        below = floor if n == 1 else p(g[1:])
        if not total[n, g[:-1]]:
            return below
        v = counts[n][g]
        own = (v - cut[n][min(v, 3) - 1]) / total[n, g[:-1]] if v else 0.0
        return own + lost[n, g[:-1]] / total[n, g[:-1]] * below

    return p


def plain_perplexity(p, text):
    t = START + clean(text)
    grams = [t[i : i + 4] for i in range(len(t) - 3)]
    return math.exp(-sum(math.log(p(g)) for g in grams) / len(grams)) if text else None


def plain_threshold(values, quantile=0.98, slack=1.25):
    """The smallest value that a share `quantile` does not exceed, times the slack."""
    s = sorted(values)
    return s[max(0, math.ceil(quantile * len(s)) - 1)] * slack


def sample(spark):
    rnd = np.random.default_rng(6)
    words = ["der", "die", "und", "haus", "baum", "ist", "gut", "42", "the", "of"]
    texts = [" ".join(rnd.choice(words, rnd.integers(2, 14))) for _ in range(60)]
    rows = [(i, t, "de" if i % 2 else "en", "x", 1) for i, t in enumerate(texts)]
    rows += [(100, None, "de", "x", 1), (101, "", None, "x", 1), (102, "zq xj " * 30, "de", "x", 1), (103, "\U0001f600 \xa0 1", None, "x", 1), (None, "die und", "de", "x", 1), (5, texts[5], "de", "x", 1)]
    rows.append((104, "der baum ist gut " * 30_000, "de", "x", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity string, id int")


def test_equals_brute_force(spark):
    docs = sample(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(3, 0, 0), (4, 1, 1), (None, 1, 0), (100, 1, 0)], "doc_id long, quality int, toxic int")
    trusted = {i for i in range(50) if i not in (3, 4)} | {100}
    held = {r.i for r in spark.createDataFrame([(i,) for i in trusted], "i long").where(F.pmod(F.xxhash64("i"), F.lit(5)) == 0).collect()}
    rows = docs.collect()
    p = plain_model([r.text for r in rows if r.doc_id in trusted - held and r.text])
    want = [plain_perplexity(p, r.text) for r in rows if r.text and len(r.text) < 1000]
    limit = plain_threshold([plain_perplexity(p, r.text) for r in rows if r.doc_id in held and r.text])
    got = quality.score(docs, labels).select("__doc.*", F.col("perplexity").alias("found"), "threshold", "rejected").drop("perplexity").collect()
    assert len(got) == len(rows)
    found = sorted(r.found for r in got if r.text and len(r.text) < 1000)
    assert np.allclose(found, sorted(want), rtol=1e-9)
    assert all(math.isclose(r.threshold, limit, rel_tol=1e-9) and r.rejected == ((r.found or 0) > r.threshold) for r in got)
    at = {r.doc_id: r for r in got}
    assert at[100].found is None and at[101].found is None and at[102].rejected and not at[5].rejected and at[104].found > 1
    # the path by shuffle gives the same
    other = quality.score(docs, labels, max_broadcast=0).select("__doc.doc_id", F.round("perplexity", 9).alias("p"), "rejected").collect()
    assert sorted(map(str, other)) == sorted(str(r) for r in quality.score(docs, labels).select("__doc.doc_id", F.round("perplexity", 9).alias("p"), "rejected").collect())


def test_no_documents_and_no_labels(spark):
    docs, none = sample(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs.limit(0), none).count() == 0
    assert quality.score(docs, none).where("rejected").count() == 0


def test_each_language_has_its_own_threshold(spark):
    """With 20 held-out documents or more a language's own quantile counts; one with fewer, and null, take that of all."""
    rnd = np.random.default_rng(8)
    words = {"de": ["der", "haus", "baum", "und", "gut"], "fr": ["ça", "être", "qüx", "zażółć", "où", "île", "çà", "œuvre"], "it": ["il", "che", "non"]}
    rows = [(i, " ".join(rnd.choice(words[lang], rnd.integers(3, 12))), lang) for i, lang in enumerate(rnd.choice(["de", "fr", "it"], 360, p=[0.48, 0.48, 0.04]).tolist())]
    rows += [(1000, "haus und baum", None), (1001, "zq!! xj## " * 5, "de"), (1002, "il che non", "it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(360)], "doc_id long, quality int, toxic int")
    held = {r.i for r in spark.range(360).toDF("i").where(F.pmod(F.xxhash64("i"), F.lit(5)) == 0).collect()}
    p = plain_model([t for i, t, _ in rows if i < 360 and i not in held])
    value = {i: plain_perplexity(p, t) for i, t, _ in rows}
    of = {x: [value[i] for i, _, lang in rows if i in held and lang == x] for x in words}
    assert len(of["de"]) >= 20 and len(of["fr"]) >= 20 > len(of["it"]) > 0
    overall = plain_threshold([v for x in of.values() for v in x])
    want = {"de": plain_threshold(of["de"]), "fr": plain_threshold(of["fr"]), "it": overall, None: overall}
    assert not math.isclose(want["de"], want["fr"], rel_tol=0.01)
    got = quality.score(docs, labels).select("__doc.doc_id", "__doc.lang", "perplexity", "threshold", "rejected").collect()
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.threshold, want[r.lang], rel_tol=1e-9) and math.isclose(r.perplexity, value[r.doc_id], rel_tol=1e-9)
        assert r.rejected == (value[r.doc_id] > want[r.lang])
    assert next(r for r in got if r.doc_id == 1001).rejected


def test_sums_do_not_depend_on_the_join(spark):
    """Bit for bit the same, whether 4-grams are broadcast or joined by shuffle."""
    docs = spark.createDataFrame([(i, f"some words {i * i} of text number {i}, and a few more " * (1 + i % 7), "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    a, b = ({(r.doc_id, r.perplexity, r.threshold, r.rejected) for r in quality.score(docs, labels, max_broadcast=m).select("__doc.doc_id", "perplexity", "threshold", "rejected").collect()} for m in (0, 2_000_000))
    assert a == b and len(a) == 60
