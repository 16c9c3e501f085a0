"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte 1- to 4-grams of a lower-cased text, digits and punctuation read as spaces, hashed into
`buckets`. A text is the mean of its subwords' embeddings. Embeddings and softmax are trained together by
stochastic gradient descent in numpy on the driver, over a bounded sample of labelled documents; a part of that
sample, kept out of the training, sets the temperature and the score below which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealedspark.layout import spread
from sealedspark.llm.common import mix32

_CLEAN = {c: " " for c in range(128) if not chr(c).isalpha()}


def features(text: str, buckets: int) -> np.ndarray:
    """Shares of the buckets among a text's subwords (float32, zeros for a text without any)."""
    data = np.frombuffer(" ".join((" " + text.lower() + " ").translate(_CLEAN).split()).encode("utf-8", "replace"), np.uint8)
    total = np.zeros(buckets, np.float64)
    for at in range(0, len(data), 1 << 20):
        part = data[at : at + (1 << 20) + 3].astype(np.uint32)
        h = np.zeros(len(part), np.uint32)
        for n in range(1, 5):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint32(257) + part[n - 1 :] + np.uint32(1)
            own = h[: 1 << 20] if at + (1 << 20) < len(data) else h
            total += np.bincount(mix32(own + np.uint32(n << 24)) % np.uint32(buckets), minlength=buckets)
    return (total / max(total.sum(), 1)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(x: np.ndarray, y: np.ndarray, classes: int, dim: int = 16, epochs: int = 60, rate: float = 0.1, seed: int = 1) -> tuple:
    """Embeddings (buckets x dim), softmax weights and bias after SGD on shuffled batches of 32."""
    rng = np.random.default_rng(seed)
    scale = np.float32(np.sqrt(x.shape[1]))
    e = rng.normal(0, 0.1, (x.shape[1], dim)).astype(np.float32)
    w = rng.normal(0, 0.1, (dim, classes)).astype(np.float32)
    b = np.zeros(classes, np.float32)
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        order = rng.permutation(len(x))
        for at in range(0, len(x), 32):
            rows = order[at : at + 32]
            own = x[rows] * scale
            h = own @ e
            z = h @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = p @ w.T
            w -= step * (h.T @ p)
            b -= step * p.sum(0)
            e -= step * (own.T @ back)
    return e * scale, w, b


def _logits(model: tuple, x: np.ndarray) -> np.ndarray:
    e, w, b = model
    return x @ e @ w + b


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def _featurize(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = [features(t, buckets).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(x, pa.binary())], names=["lang", "x"])

    return run


def fit(labelled: DataFrame, sample: int = 4000, buckets: int = 4096, reject: float = 0.01) -> dict:
    """A model from `labelled` (doc_id, text, lang), on at most `sample` of its distinct rows with a text and a lang.

    The bound is this parameter, so the driver holds at most sample x buckets floats. Every language has an equal
    part of the sample (what a rare one leaves goes to the others), the most frequent sample / 8 languages if there
    are more. Of each language those rows are taken whose hash of doc_id and text is smallest; repeated rows have one
    hash and count once. Distinct hashes are counted first, and only rows whose hash can be among the smallest are
    sorted. A fifth of the sample calibrates: the temperature of least log loss, and the threshold under which a
    share `reject` of it falls. Without a usable row there are no labels.
    """
    use = labelled.where("lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    use = use.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"))
    counts = use.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(max(1, sample // 8)).collect()
    parts, left = [], sample
    for i, r in enumerate(sorted(counts, key=lambda r: (r.n, r.lang))):
        quota = left // (len(counts) - i)
        left -= min(quota, r.n)
        # a tenth above the estimate of the count, and some more, so that enough rows pass
        share = (1.2 * quota + 100) / max(r.n, 1)
        parts.append((r.lang, quota, 2**63 - 1 if share >= 1 else int((share - 0.5) * 2**64)))
    parts = labelled.sparkSession.createDataFrame(parts, "lang string, quota long, most long")
    near = use.join(F.broadcast(parts), "lang").where("h <= most")
    keys = near.select("lang", "h", "quota").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    keys = keys.where("nth <= quota").select("lang", "h")
    use = near.select("lang", "h", "text").join(F.broadcast(keys), ["lang", "h"]).groupBy("h", "lang").agg(F.min("text").alias("text"))
    rows = use.orderBy("h", "lang").select("lang", "text").mapInArrow(_featurize(buckets), "lang string, x binary").collect()
    labels = sorted({r.lang for r in rows})
    model = {"labels": labels, "buckets": buckets, "temperature": 1.0, "threshold": 0.0}
    if not rows:
        return model
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows])
    y = np.array([labels.index(r.lang) for r in rows])
    held = np.arange(len(x)) % 5 == 4
    model["net"] = train(x[~held], y[~held], len(labels))
    if held.any():
        z = _logits(model["net"], x[held])
        loss = {t: -np.log(_softmax(z / t)[np.arange(len(z)), y[held]] + 1e-12).mean() for t in (0.25, 0.5, 0.7, 1, 1.4, 2, 3, 4, 6)}
        model["temperature"] = float(min(loss, key=loss.get))
        model["threshold"] = float(np.quantile(_softmax(z / model["temperature"]).max(1), reject))
    return model


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of `docs` (doc_id, text; other columns are ignored).

    lang_pred is `und`, with score 0 and rejected, where the text is null or has no letter or nothing was
    learned. The model has a fixed size (buckets x 16 floats, 256 KB), so it is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lang, score = [], []
            for t in batch.column("text").to_pylist():
                if not m["labels"] or not has_letter(t):
                    lang.append("und")
                    score.append(0.0)
                    continue
                p = _softmax(_logits(m["net"], features(t, m["buckets"])[None])[0] / m["temperature"])
                lang.append(m["labels"][int(p.argmax())])
                score.append(min(1.0, float(p.max())))
            no = [s < m["threshold"] or x == "und" for s, x in zip(score, lang, strict=True)]
            out = [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(no, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "rejected"])

    src = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out():
    """Whether a row belongs to the test fold: crc32 of doc_id as text, modulo 5, is 0. Null doc_ids do not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
