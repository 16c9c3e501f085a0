"""Authorised top-k retrieval. The gate is a filter of its own below the scoring."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealedspark import policy_rows
from sealedspark.ipfe import Public, Requests, Scheme, derive, inner_product, numbers
from sealedspark.layout import blocks, broadcast_if_few, pin, shuffled, spread
from sealedspark.policy import satisfied
from sealedspark.vectors import dot, norm, quantize
from sealedspark.wire import check_wire

MAX_REQUESTS = 10_000
# So many granted (request, policy) rows are broadcast at most; more are joined by shuffle.
MAX_GRANTS = 1_000_000
# Numbers of matrices are at most so large: products of whole ones are exact in double precision, squares are finite.
LARGEST = {"bigint": float(1 << 20), "double": 1e15}
# So many requests are multiplied with half as many documents at once.
TILE = 1024
# So many ciphertexts are scored at once.
CHUNK = 128


def _best(scored: DataFrame, k: int) -> DataFrame:
    if k < 0:
        raise ValueError("k is at least 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def gate(docs: DataFrame, callers: DataFrame, policies: list[str]) -> DataFrame:
    """`docs` (policy, ...) beside each caller_id that may read them; callers x policies is evaluated once."""
    return docs.join(broadcast_if_few(satisfied(callers, policies), MAX_REQUESTS * max(1, len(set(policies)))), "policy")


def granted(block: DataFrame, policies: list[str] | DataFrame) -> DataFrame:
    """query_id, policy: what each request of a block may read. Policies come as a list or as a table (policy)."""
    callers = block.select(F.col("query_id").alias("caller_id"), "attrs")
    if isinstance(policies, DataFrame):
        ok = broadcast_if_few(pin(policy_rows.satisfied(callers, policies)), MAX_GRANTS)
    elif MAX_REQUESTS * len(policies) <= MAX_GRANTS:  # a bound without counting
        ok = F.broadcast(satisfied(callers, policies))
    else:
        ok = broadcast_if_few(satisfied(callers, policies), MAX_GRANTS)
    return ok.withColumnRenamed("caller_id", "query_id")


def authorized_pairs(docs: DataFrame, requests: DataFrame, policies: list[str] | DataFrame | None) -> list[DataFrame]:
    """`docs` (policy, ...) beside each request (query_id, attrs, ...) that may read them, by blocks of requests.

    A block has at most about MAX_REQUESTS requests and is broadcast, so documents are never shuffled for it. A policy
    of null denies; without `policies` nothing is gated.
    """
    parts, out = blocks(requests, "query_id", MAX_REQUESTS), []
    if len(parts) > 1:
        docs = pin(docs)  # each block reads them
    for block in parts:
        asked = F.broadcast(block.drop("attrs"))
        if policies is None:
            out.append(docs.crossJoin(asked))
        else:
            out.append(docs.join(granted(block, policies), "policy").join(asked, "query_id"))
    return out


def _whole(v: Column, dim: int, most: float) -> Column:
    """Whether a vector goes into a matrix: `dim` numbers of at most `most`, none of them null."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= most)), F.lit(False))


def _exact(v: np.ndarray, n: np.ndarray, a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The scores of pairs of rows, summed from the first component on as `dot` does."""
    out = np.zeros(len(v))
    for j in range(v.shape[1]):
        out += v[:, j] * a[:, j]
    return out / (n * m)


class _Held:
    """The k best (score, doc_id) so far of each request of a block."""

    def __init__(self, size: int, k: int):
        self.k, self.score, self.doc = k, np.full((size, k), -np.inf), np.full((size, k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """Take in pairs of requests `q`, equal ones side by side."""
        own, k = q[np.flatnonzero(np.diff(q, prepend=-1))], self.k
        q, score, doc = np.concatenate([np.repeat(own, k), q]), np.concatenate([self.score[own].ravel(), score]), np.concatenate([self.doc[own].ravel(), doc])
        order = np.lexsort((doc, -score, q))
        q = q[order]
        keep = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
        own = np.sort(own)
        self.score[own], self.doc[own] = score[keep].reshape(-1, k), doc[keep].reshape(-1, k)


def _best_of(shared, k: int):
    """A function of Arrow batches (doc_id, vec, n, at): for each request of a block its k best of the partition.

    Tiles of requests and documents are multiplied in single precision. What comes within its error of a request's
    k-th score is scored again in double precision, and only these scores count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, m, unit, grants = shared.value
        size = np.sqrt((asked * asked).sum(1))
        small = (asked / np.where(size == 0, 1.0, size)[:, None]).astype(np.float32)
        held = _Held(len(ids), k)
        for batch in batches:
            vecs = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(batch), asked.shape[1])
            docs, n, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n", "at"))
            near = (vecs / n[:, None]).astype(np.float32)
            error = (vecs.shape[1] + 16) * 2.0**-23 * float(np.sqrt((near * near).sum(1).max(initial=0))) + 1e-30
            for group in np.unique(at):
                rows, who = np.flatnonzero(at == group), grants[group]
                for i, j in product(range(0, len(who), TILE), range(0, len(rows), TILE // 2)):
                    q, d = who[i : i + TILE], rows[j : j + TILE // 2]
                    score = small[q] @ near[d].T
                    least = held.score[q, -1] / unit[q] - error
                    hit = np.flatnonzero(score.max(1) >= least)
                    if not len(hit):
                        continue
                    q, score, least = q[hit], score[hit], least[hit]
                    new = np.flatnonzero(np.isinf(least))
                    if len(new) and len(d) > k:  # k of the tile itself are as near
                        least[new] = np.partition(score[new], -k, 1)[:, -k] - 2 * error
                    x, y = np.nonzero(score >= least.astype(np.float32)[:, None])
                    for lo in range(0, len(x), 1 << 16):
                        qs, ds = q[x[lo : lo + (1 << 16)]], d[y[lo : lo + (1 << 16)]]
                        held.add(qs, _exact(vecs[ds], n[ds], asked[qs], m[qs]), docs[ds])
        q, i = np.nonzero(held.score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(held.doc[q, i]), pa.array(held.score[q, i])], names=["query_id", "doc_id", "score"])

    return run


def _by_matrix(docs: DataFrame, block: DataFrame, policies: list[str] | DataFrame | None, dim: int, k: int) -> DataFrame | None:
    """query_id, doc_id, score of candidates: the k best of each partition of `docs` for every request of a block.

    The gate stays below the scoring: documents are joined with the policies that are granted, and multiplied with the
    requests that each is granted to. None where more than MAX_GRANTS rows are granted.
    """
    spark = docs.sparkSession
    t = block.select("query_id", "vec", "n", "unit").toArrow()  # one block
    ids = t.column("query_id").to_numpy()
    asked = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), dim)
    grants = [np.arange(len(ids))]
    if policies is None:
        docs = docs.withColumn("at", F.lit(0))
    else:
        ok = pin(granted(block.select("query_id", "attrs"), policies).distinct())
        if ok.count() > MAX_GRANTS:
            return None
        names, grants = _grants(ids, ok)
        docs = docs.join(F.broadcast(spark.createDataFrame(list(enumerate(names)), "at int, policy string")), "policy")
    shared = spark.sparkContext.broadcast((ids, asked, t.column("n").to_numpy(), t.column("unit").to_numpy(), grants))
    return docs.select("doc_id", "vec", "n", "at").mapInArrow(_best_of(shared, k), "query_id long, doc_id long, score double")


def _grants(ids: np.ndarray, ok: DataFrame) -> tuple[list[str], list[np.ndarray]]:
    """The granted policies of `ok` (query_id, policy), and for each the places of the requests that it is granted to."""
    got = ok.toArrow()
    names, code = np.unique(got.column("policy").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    places: dict = {}
    for place, i in enumerate(ids.tolist()):
        places.setdefault(i, []).append(place)
    out: list[list] = [[] for _ in names]
    for i, c in zip(got.column("query_id").to_pylist(), code.tolist(), strict=True):
        out[c] += places[i]
    return names.tolist(), [np.array(x, np.int64) for x in out]


def _ranked(docs: DataFrame, requests: DataFrame, policies: list[str] | DataFrame | None, kind: str, k: int, block_bytes: int = 1 << 25) -> DataFrame:
    """The k best documents of each request by the products of vectors of `kind`, divided by both lengths n.

    docs: doc_id, vec, n, policy. requests: query_id, vec, n, unit (what a score is divided by so that it is one of unit
    requests), attrs. Requests go to all documents in blocks of about `block_bytes`, as a matrix. Vectors that hold null,
    no finite or very large numbers, or have another length than the others, are scored a pair at a time.
    """
    plain = dot(F.col("vec"), F.col("qv"), kind) if kind == "bigint" else dot(F.col("vec"), F.col("qv")) / (F.col("n") * F.col("qn"))
    key, named = requests.schema["query_id"].dataType, docs.schema["doc_id"].dataType

    def pairwise(d: DataFrame, r: DataFrame) -> list[DataFrame]:
        asked = r.select("query_id", F.col("vec").alias("qv"), F.col("n").alias("qn"), "attrs")
        return [p.select("query_id", "doc_id", plain.alias("score")) for p in authorized_pairs(d, asked, policies)]

    if k < 1 or not (isinstance(key, T.IntegralType) and isinstance(named, T.IntegralType)):
        return reduce(DataFrame.union, [_best(p, k) for p in pairwise(docs, requests)])  # a request is in one block only
    requests = pin(requests)
    dim = requests.agg(F.max(F.size("vec"))).first()[0] or 0
    most = LARGEST[kind] if dim <= 4096 else -1.0
    fit = _whole(F.col("vec"), dim, most)
    docs, fits_q, fits_d = spread(docs), fit & F.col("query_id").isNotNull(), fit & F.col("doc_id").isNotNull()
    good, odd = requests.where(fits_q), requests.where(~fits_q)
    rows = max(1, block_bytes // (8 * (max(1, dim) + 2 * k)))
    if isinstance(policies, list):
        rows = max(1, min(rows, MAX_GRANTS // max(1, len(policies))))
    parts, out = blocks(good, "query_id", rows), []
    if len(parts) > 1:
        docs = pin(docs)  # each block reads them
    loose = docs.where(~fits_d).count()
    for block in parts:
        best = _by_matrix(docs.where(fits_d), block, policies, dim, k)
        if best is None:
            out += [_best(p, k) for p in pairwise(docs, block)]
            continue
        best = best.select(F.col("query_id").cast(key).alias("query_id"), F.col("doc_id").cast(named).alias("doc_id"), F.col("score").cast(kind).alias("score"))
        if loose:
            best = reduce(DataFrame.union, pairwise(docs.where(~fits_d), block), best)
        out.append(_best(best, k))
    if odd.count():
        out += [_best(p, k) for p in pairwise(docs, odd)]
    return reduce(DataFrame.union, [pin(o) for o in out] if len(parts) > 1 else out)


def nearest_counts(docs: DataFrame, requests: DataFrame, k: int, block_bytes: int = 1 << 25) -> DataFrame:
    """query_id, doc_id, score, rank: the k nearest by cosine of count vectors; ties go to the smaller doc_id.

    docs: doc_id (bigint), vec. requests: query_id (bigint, distinct), vec. Vectors hold whole numbers (hashed bags of
    words), whose products are exact in double precision, so that equal texts tie whatever the order of the sums. A
    vector of zeros has a cosine of 0 with all. Blocks of requests of `block_bytes` go to all documents as one matrix;
    each partition of documents gives k rows a request on.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    return rank_plain(docs.withColumn("policy", F.lit(None).cast("string")), requests.withColumn("attrs", F.lit(None).cast("array<string>")), None, k, block_bytes)


def rank_quantized(docs: DataFrame, requests: DataFrame, policies: list[str] | DataFrame | None, k: int, quant_bits: int = 2) -> DataFrame:
    """The k best documents of each request by exact integer dot product of quantised vectors.

    docs: doc_id, vec, policy. requests: query_id, vec, attrs. Without `policies` nothing is gated.
    Ties go to the smaller doc_id. Returns query_id, doc_id, score (bigint), rank.
    """
    vec, one = quantize(F.col("vec"), quant_bits).alias("vec"), F.lit(1.0).alias("n")
    d = docs.select("doc_id", "policy", vec, one)
    r = requests.select("query_id", vec, one, "attrs")
    size = norm(F.col("vec"))
    return _ranked(d, r.withColumn("unit", F.when(size > 0, size).otherwise(1.0)), policies, "bigint", k)


def rank_plain(docs: DataFrame, requests: DataFrame, policies: list[str] | DataFrame | None, k: int, block_bytes: int = 1 << 25) -> DataFrame:
    """Like `rank_quantized`, by cosine in double precision."""
    # norms are computed once a vector, not once a pair; a zero norm counts as 1
    sized = lambda df, *more: df.select(*more, F.col("vec").cast("array<double>").alias("vec")).withColumn("n", norm(F.col("vec")))
    one = F.when(F.col("n") == 0, 1.0).otherwise(F.col("n")).alias("n")
    d = sized(docs, "doc_id", "policy").select("doc_id", "policy", "vec", one)
    r = sized(requests, "query_id", "attrs").select("query_id", "vec", one, F.lit(1.0).alias("unit"), "attrs")
    return _ranked(d, r, policies, "double", k, block_bytes)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, list]]:
    """Documents of Arrow batches (doc_id, ct, at) by what they are granted to: `at`, ids and ciphertexts of up to CHUNK."""
    held: dict = {}

    def let_go(at: int) -> tuple[int, pa.Array, list]:
        docs, cts = held.pop(at)
        return at, pa.array(docs, kind), cts

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for lo in range(0, len(batch), CHUNK):
            for doc, ct, at in zip(*(c.to_pylist() for c in batch.slice(lo, CHUNK).select(["doc_id", "ct", "at"]).columns), strict=True):
                docs, cts = held.setdefault(at, ([], []))
                docs.append(doc)
                cts.append(numbers(ct))
                if len(docs) == CHUNK:
                    yield let_go(at)
            if sum(len(docs) for docs, _ in held.values()) > 16 * CHUNK:
                yield from map(let_go, list(held))
    yield from map(let_go, list(held))


def _scored(public: Public, shared, k: int | None):
    """A function of Arrow batches (doc_id, ct, at): a chunk of documents is scored for all requests that may read it.

    What it holds at once is a chunk's scores and powers. With `k` only the k best of each request are given on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, vectors, grants = shared.value
        asked, held, done, waiting = {}, k and _Held(len(ids), k), [], 0
        names = ["query_id", "doc_id", "score"]
        for at, docs, cts in _together(batches):
            who = grants[at]
            if at not in asked:
                asked[at] = Requests(public, [keys[i] for i in who], vectors[who])
            scores = asked[at].scores(cts)
            if k:
                least = held.score[who, -1]
                if len(docs) > k and (new := np.flatnonzero(np.isinf(least))).size:  # k of the chunk itself are as near
                    least[new] = np.partition(scores[new], -k, 1)[:, -k]
                x, y = np.nonzero(scores >= least[:, None])
                if len(x):
                    held.add(who[x], scores[x, y], docs.to_numpy(zero_copy_only=False)[y])
                continue
            doc = docs.take(pa.array(np.tile(np.arange(len(docs)), len(who))))
            done.append(pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[who], len(docs))), doc, pa.array(scores.ravel())], names=names))
            waiting += scores.size
            if waiting >= 1 << 16:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done, waiting = [], 0
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if k:
            q, i = np.nonzero(held.score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(held.doc[q, i]), pa.array(held.score[q, i].astype(np.int64))], names=names)

    return run


def sealed_pairs(scheme: Scheme, docs: DataFrame, requests: DataFrame, policies: list[str] | DataFrame, k: int | None = None) -> DataFrame:
    """query_id, doc_id, score for every document that a request may read: the raw integer inner product.

    docs: doc_id, policy, ct. requests: query_id (distinct), attrs, q (quantised). The key holder's executors make one
    key per request; what goes to the scoring side is checked to be ids, attributes, integers and keys (`check_wire`).
    Requests are scored in blocks of at most about MAX_REQUESTS, or four times as many where few policies are granted,
    whose keys are broadcast to the workers; with several blocks each one's scores are written before the next, so that
    neither plan nor driver grows with them. Only independent requests are decrypted (`Requests.basis`). With `k`,
    where ids of documents are bigint, pairs that are not among a request's k best of a partition may be left out.
    """
    if not scheme.msk:
        raise ValueError("functional keys need the master secret")
    spark = docs.sparkSession
    wire = pin(check_wire(requests.select("query_id", "attrs", F.col("q").cast("array<bigint>").alias("q"), derive(scheme, F.col("q")).alias("sk"))))
    rows = max(1, min(4, MAX_GRANTS // max(1, MAX_REQUESTS * len(policies)))) * MAX_REQUESTS if isinstance(policies, list) else MAX_REQUESTS
    if (k or 0) * rows > 1 << 22:
        rows = MAX_REQUESTS
    parts, scored = blocks(wire.where("query_id IS NOT NULL"), "query_id", rows), []
    if len(parts) > 1:
        docs = pin(docs)  # ciphertexts are random and costly, so they are made once
    named = docs.schema["doc_id"].dataType
    kind = T.StructType([T.StructField("query_id", T.LongType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])
    if not isinstance(named, T.LongType) or not 0 < (k or 0) * rows <= 1 << 22:
        k = None
    sealed = docs.where("doc_id IS NOT NULL") if k else docs
    for block in parts:
        ok = pin(granted(block, policies).select("query_id", "policy").distinct())
        if ok.count() > MAX_GRANTS:  # a pair is a row
            asked = F.broadcast(block.select(F.col("query_id").cast("long").alias("query_id"), "sk", "q"))
            pairs = docs.join(shuffled(ok), "policy").join(asked, "query_id")
            one = pairs.select("query_id", "doc_id", inner_product(scheme.public, F.col("ct"), F.col("sk"), F.col("q")).alias("score"))
        else:
            t = block.select(F.col("query_id").cast("long").alias("query_id"), "sk", "q").toArrow()  # one block
            ids = t.column("query_id").to_numpy()
            vectors = t.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), len(scheme.msk))
            names, grants = _grants(ids, ok)
            places = F.broadcast(spark.createDataFrame(list(enumerate(names)), "at int, policy string"))
            shared = spark.sparkContext.broadcast((ids, t.column("sk").to_pylist(), vectors, grants))
            one = sealed.join(places, "policy").select("doc_id", "ct", "at").mapInArrow(_scored(scheme.public, shared, k), kind)
        scored.append(pin(one) if len(parts) > 1 else one)
    return reduce(DataFrame.union, scored)


def rank_sealed(scheme: Scheme, docs: DataFrame, requests: DataFrame, policies: list[str] | DataFrame, k: int) -> DataFrame:
    """The k best of `sealed_pairs` by request: query_id, doc_id, score, rank."""
    return _best(sealed_pairs(scheme, docs, requests, policies, k), k)


def as_cosine(score: Column, quant_bits: int) -> Column:
    """The cosine that an integer score of unit vectors stands for."""
    return score / F.lit(float(10 ** (2 * quant_bits)))


def hit_rate(found: DataFrame, truth: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """query_id, hit_rate: the share of each query's true doc_ids that were found.

    With `queries` (query_id), a query without any true doc_id is an error.
    """
    t, f = truth.select("query_id", "doc_id").distinct(), found.select("query_id", "doc_id").distinct()
    both = t.join(f.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    if queries is not None:
        both = queries.select("query_id").distinct().join(both, "query_id", "left")
    rate = F.when(F.count("doc_id") == 0, F.raise_error(F.lit("a query has no true document"))).otherwise(F.count("hit") / F.count("doc_id"))
    return both.groupBy("query_id").agg(rate.cast("double").alias("hit_rate"))


def compare(found: dict[str, DataFrame], truth: DataFrame, rounds: dict[str, float], tampers: dict[str, float], provenance: bool = False) -> DataFrame:
    """One row per way of retrieval and metric: way, metric, value, and with `provenance` measured_on and environment.

    `found` maps a way (`baseline`, `improved`) to its ranking, `truth` is the unfiltered ranking and must be given;
    `rounds` and `tampers` are each way's verification rounds and share of detected tampering.
    """
    if truth is None or not found:
        raise ValueError("the true ranking and the rankings to compare are required")
    out, truth = [], pin(truth.select("query_id", "doc_id"))  # each way is held against it
    for way, df in found.items():
        out.append(hit_rate(df, truth).agg(F.avg("hit_rate").alias("value")).select(F.lit(way).alias("way"), F.lit("authorized_hit_rate").alias("metric"), "value"))
        fixed = [(way, "verification_rounds", float(rounds[way])), (way, "tamper_detection_rate", float(tampers[way]))]
        out.append(truth.sparkSession.createDataFrame(fixed, "way string, metric string, value double"))
    table = reduce(DataFrame.union, out)
    where = f"Spark {truth.sparkSession.version}, {truth.sparkSession.sparkContext.master}"
    return table.withColumns({"measured_on": F.current_date(), "environment": F.lit(where)}) if provenance else table


def median_ms(call, n: int = 7) -> float:
    """The upper median of the milliseconds that `n` calls take."""
    took = []
    for _ in range(n):
        began = time.perf_counter()
        call()
        took.append((time.perf_counter() - began) * 1000)
    return sorted(took)[n // 2]
