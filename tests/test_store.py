import datetime
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from sealedspark import embedding, grounding, inference, ingest, integrity, ipfe, policy, privacy, retrieval, store, streaming, vectors, wire

KEY = bytes(range(32))


def corpus(spark, n=20):
    rows = [(f"d{i:03}", bytearray([i, 255]), "role:nurse", {"dim": "8", "n": str(i)}, 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, ct binary, tag string, meta map<string,string>, version long")


def test_every_field_of_every_document_is_sealed(spark):
    sealed = integrity.seal(corpus(spark), KEY)
    manifest = sealed.select("doc_id", "version")
    assert integrity.verify(sealed, manifest, KEY).count() == 0
    damage = {
        "ct": F.concat("ct", F.lit(b"\0")), "tag": F.lit(None).cast("string"), "meta": F.map_concat("meta", F.create_map(F.lit("x"), F.lit(""))), "version": F.col("version") + 1}
    for column, value in damage.items():
        bad = integrity.verify(sealed.withColumn(column, value), manifest, KEY)
        assert bad.where("reason = 'mac_mismatch'").count() == 20, column
    swapped = sealed.withColumn("doc_id", F.when(F.col("doc_id") == "d000", "d001").when(F.col("doc_id") == "d001", "d000").otherwise(F.col("doc_id")))
    assert {r.doc_id for r in integrity.verify(swapped, manifest, KEY).collect()} == {"d000", "d001"}
    assert integrity.verify(sealed.withColumn("meta", F.map_from_entries(F.reverse(F.map_entries("meta")))), manifest, KEY).count() == 0


def test_empty_and_null_seal_differently(spark):
    a = spark.createDataFrame([(1, "", "", 1), (1, None, "", 1), (1, "", None, 1)], "doc_id long, ct string, tag string, version long")
    assert integrity.seal(a, KEY).select("mac").distinct().count() == 3
    ints = spark.createDataFrame([(1, [1, 23], "t", 1), (1, [12, 3], "t", 1)], "doc_id long, ct array<long>, tag string, version long")
    assert integrity.seal(ints, KEY).select("mac").distinct().count() == 2


def test_keys_and_manifests(spark, tmp_path):
    at = str(tmp_path / "key")
    assert integrity.load_key(at) == integrity.load_key(at) and integrity.load_key(at, KEY) == KEY
    with pytest.raises(ValueError):
        integrity.load_key(at, b"short")
    m = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, version long")
    grown = integrity.registered(m, spark.createDataFrame([("b", 3), ("c", 1)], "doc_id string, version long"))
    integrity.save_manifest(grown, str(tmp_path / "m"))
    got = integrity.load_manifest(spark, str(tmp_path / "m"), "string")
    assert {(r.doc_id, r.version) for r in got.collect()} == {("a", 1), ("b", 3), ("c", 1)}
    (tmp_path / "m" / "save=2" / "_temporary").mkdir(parents=True)  # a save that died
    assert integrity.load_manifest(spark, str(tmp_path / "m"), "string").count() == 3
    integrity.save_manifest(m, str(tmp_path / "k"))
    integrity.save_manifest(grown, str(tmp_path / "k"))
    assert integrity.load_manifest(spark, str(tmp_path / "k"), "string").count() == 3
    with pytest.raises(FileNotFoundError):
        integrity.load_manifest(spark, str(tmp_path / "none"))
    (tmp_path / "bad.json").write_text(json.dumps({"ids": []}))
    with pytest.raises(ValueError):
        integrity.load_manifest(spark, str(tmp_path / "bad.json"))
    assert integrity.incidents(integrity.verify(integrity.seal(corpus(spark), KEY), m, KEY).where("doc_id = 'a'")).first().note == "registered but absent"


def test_store(spark, tmp_path):
    path = str(tmp_path / "s")
    c = corpus(spark, 6).select(F.col("doc_id").alias("chunk_id"), F.col("ct").alias("blob"), "tag", "meta")
    store.put(c, KEY, path)
    got = {r.chunk_id: r for r in store.get(spark, KEY, path).collect()}
    assert len(got) == 6 and bytes(got["d003"].blob) == b"\x03\xff" and got["d003"].meta == {"dim": "8", "n": "3"} and got["d003"].reason is None
    assert all(r.reason == "store_unreadable" for r in store.get(spark, b"x" * 32, path).collect())
    store.put(c.where("chunk_id = 'd001'").withColumn("tag", F.lit("new")), KEY, path)
    store.delete(spark.createDataFrame([("d002",)], "chunk_id string"), path)
    got = {r.chunk_id: r.tag for r in store.get(spark, KEY, path).collect()}
    assert got["d001"] == "new" and "d002" not in got and store.list_ids(spark, path).count() == 5
    with pytest.raises(KeyError):
        store.delete(spark.createDataFrame([("nope",)], "chunk_id string"), path)
    raw = spark.read.parquet(f"{path}/chunks").select("sealed").collect()
    assert not any(b"role:nurse" in bytes(r.sealed or b"") for r in raw)
    assert "000102030405" not in store.encrypt(c, KEY)._jdf.queryExecution().toString().replace(" ", "").replace(",", "")
    with pytest.raises(ValueError):
        store.encrypt(c, b"short")


def chunks_of(spark, rows):
    return spark.createDataFrame([(i, bytearray(t.encode()), t, {"n": t}) for i, t in rows], "chunk_id string, blob binary, tag string, meta map<string,string>")


def tags(df):
    return {r.chunk_id: r.tag for r in df.collect()}


def test_a_put_is_there_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    assert store.put(chunks_of(spark, [("a", "a1"), ("b", "b1")]), KEY, path) == 1
    for bad in ([("c", "c1"), ("c", "c2")], [(None, "x")]):
        with pytest.raises(ValueError):
            store.put(chunks_of(spark, bad), KEY, path)

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", die)
        with pytest.raises(RuntimeError):
            store.put(chunks_of(spark, [("a", "lost"), ("d", "lost")]), KEY, path)
    assert tags(store.get(spark, KEY, path)) == {"a": "a1", "b": "b1"}
    assert store.put(chunks_of(spark, [("a", "a2"), ("e", "e1")]), KEY, path) == 3  # the number of the lost put is not used again
    assert tags(store.get(spark, KEY, path)) == {"a": "a2", "b": "b1", "e": "e1"}
    monkeypatch.setattr(store, "_last_put", lambda *_: 0)
    with pytest.raises(Exception, match="already exists"):
        store.put(chunks_of(spark, [("a", "second writer")]), KEY, path)
    assert tags(store.get(spark, KEY, path))["a"] == "a2"


def test_deleted_chunks_come_back_only_by_a_put(spark, tmp_path):
    path = str(tmp_path / "s")
    store.put(chunks_of(spark, [("a", "a1"), ("b", "b1")]), KEY, path)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "chunk_id string")
    store.delete(ids("a", "a"), path)
    assert tags(store.get(spark, KEY, path)) == {"b": "b1"} == tags(store.get(spark, KEY, path, ["a", "b", "zz"]))
    with pytest.raises(KeyError):
        store.delete(ids("a"), path)
    store.put(chunks_of(spark, [("a", "a3")]), KEY, path)
    assert tags(store.get(spark, KEY, path, ["a"])) == {"a": "a3"}
    with pytest.raises(FileNotFoundError):
        store.list_ids(spark, str(tmp_path / "none"))


def test_some_ids_read_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "s")
    store.put(chunks_of(spark, [(f"c{i}", f"t{i}") for i in range(400)]), KEY, path, buckets=64)
    store.put(chunks_of(spark, [("c7", "new")]), KEY, path, buckets=8)
    some = store.get(spark, KEY, path, ["c7", "c9", "c9"])
    assert tags(some) == {"c7": "new", "c9": "t9"}
    plan = some._jdf.queryExecution().executedPlan()
    files = [line for line in plan.toString().split("\n") if "FileScan" in line and "sealed" in line]
    assert files and all("bucket" in f.split("PartitionFilters:")[1].split("PushedFilters")[0] for f in files)
    read = spark.read.option("basePath", f"{path}/chunks").parquet(f"{path}/chunks").select("put", "bucket").distinct().count()
    assert read > 40  # of which the two ids need two


def test_compaction(spark, tmp_path):
    old, new = str(tmp_path / "s"), str(tmp_path / "t")
    for i in range(3):
        store.put(chunks_of(spark, [("a", f"a{i}"), (f"b{i}", "b")]), KEY, old)
    store.delete(spark.createDataFrame([("b0",)], "chunk_id string"), old)
    want = {"a": "a2", "b1": "b", "b2": "b"}
    assert store.compact(spark, old, new) == 4 and tags(store.get(spark, KEY, new)) == want == tags(store.get(spark, KEY, old))
    assert spark.read.parquet(f"{new}/chunks").count() == 3
    assert store.put(chunks_of(spark, [("b1", "c")]), KEY, new) == 5 and tags(store.get(spark, KEY, new)) == want | {"b1": "c"}


def test_resolved_spans(spark):
    rows = [("One  two.\n\nThree four.  One two.", ["One two.", "One two."]), ("a b", ["b", "a"]), ("x y", []), ("", ["q"]), ("aa a", ["a"]), ("x", ["", " x "])]
    df = spark.createDataFrame([(t, [(0, 0, s) for s in x]) for t, x in rows], "t string, s array<struct<start:long,end:long,text:string>>")
    got = [r.r for r in df.select(grounding.resolve_spans(F.col("t"), F.col("s")).alias("r")).collect()]
    place = lambda r: [(s.start, s.end) for s in r.spans] if r.spans is not None else r.missing
    assert [place(r) for r in got] == [[(0, 9), (24, 32)], "a", [], "q", [(3, 4)], [(0, 1)]]


def test_wire():
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    good = s.createDataFrame([(1, ["a:b"], [1], bytearray(b"k"))], wire.WIRE)
    assert wire.check_wire(good) is good
    for bad in (good.withColumn("text", F.lit("x")), good.drop("sk"), good.withColumn("q", F.col("q").cast("array<double>"))):
        with pytest.raises(ValueError):
            wire.check_wire(bad)


def test_scheme_is_kept(tmp_path):
    at = str(tmp_path / "scheme")
    a = ipfe.load_or_setup(at, 4, 64)
    assert ipfe.load_or_setup(at, 4, 64) == a and (tmp_path / "scheme").stat().st_mode & 0o077 == 0
    with pytest.raises(ValueError):
        ipfe.load_or_setup(at, 5, 64)


def test_sealing_needs_the_secret(spark):
    a = ipfe.Scheme.setup(2, 64)
    with pytest.raises(ValueError):
        retrieval.sealed_pairs(ipfe.Scheme(a.public, ()), None, None, [])


def test_requests_in_blocks_equal_one_block(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)], "role:nurse") for i in range(40)], "doc_id long, vec array<double>, policy string")
    ask = spark.createDataFrame([(i, [1.0, float(i), 0.5], ["role:nurse"] if i % 2 else ["role:x"]) for i in range(30)], "query_id long, vec array<double>, attrs array<string>")
    want = sorted(map(tuple, retrieval.rank_plain(docs, ask, ["role:nurse"], 3).collect()))
    monkeypatch.setattr(retrieval, "MAX_REQUESTS", 7)
    assert sorted(map(tuple, retrieval.rank_plain(docs, ask, ["role:nurse"], 3).collect())) == want and len(want) == 45


def test_hit_rates(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "query_id long, doc_id long")
    truth = pairs([(1, 1), (1, 2), (2, 5)])
    got = {r.query_id: r.hit_rate for r in retrieval.hit_rate(pairs([(1, 2), (1, 9)]), truth, pairs([(1, 0), (2, 0)])).collect()}
    assert got == {1: 0.5, 2: 0.0}
    with pytest.raises(Exception, match="no true document"):
        retrieval.hit_rate(pairs([(1, 2)]), truth, pairs([(3, 0)])).collect()
    with pytest.raises(ValueError):
        retrieval.compare({}, None, {}, {})
    told = retrieval.compare({"a": pairs([(1, 2), (2, 5)])}, truth, {"a": 2.5}, {"a": 1.0}, provenance=True).collect()
    assert {(r.way, r.metric, r.value) for r in told} == {("a", "authorized_hit_rate", 0.75), ("a", "verification_rounds", 2.5), ("a", "tamper_detection_rate", 1.0)}
    assert all(r.measured_on and r.environment.startswith("Spark ") for r in told)
    assert retrieval.median_ms(lambda: None) >= 0


def test_embeddings(spark):
    assert embedding.mode(None) == "hash" and embedding.mode(embedding.hash_embedder(64)) == "hash"
    live = lambda texts: [[float(len(t)), 3.0] for t in texts]
    assert embedding.mode(live) == "live" and embedding.available(live)

    def down(texts):
        raise OSError

    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: list(r.vec) for r in embedding.embed(docs, 16, down).collect()}
    dense = {r.doc_id: list(r.vec) for r in vectors.hash_vectors(docs, 16).collect()}
    assert rows[1] == pytest.approx(dense[1]) and rows[2] == dense[2] == [0.0] * 16 and sum(x * x for x in rows[1]) == pytest.approx(1)
    assert embedding.embed_texts(["abc"], 3, live, normalize=False) == [[3.0, 3.0, 0.0]]
    assert embedding.complete(lambda p: f"  {p}\n", "x") == "x"
    got = spark.createDataFrame([([3.0, 4.0, 9.0],), ([0.0],)], "v array<double>").select(vectors.l2_normalize(F.col("v"), 2).alias("n"), vectors.cosine(F.col("v"), F.col("v")).alias("c")).collect()
    assert got[0].n == [0.6, 0.8] and got[1].n == [0.0, 0.0] and got[0].c == pytest.approx(1) and got[1].c == 0


def test_unknown_replies_are_errors(spark):
    e = spark.createDataFrame([("s", 1, "none")], "subject string, round int, reply string")
    with pytest.raises(Exception, match="no level"):
        inference.posterior(e, ["a", "b"]).collect()
    tie = inference.top(inference.posterior(e.withColumn("reply", F.lit("")), ["b", "a"])).first()
    assert tie.level == "b" and not tie.granted


def test_noise_hides_exact_figures(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 500.0), ("b", None)], "k string, x double")
    out = privacy.noisy_sums(df, ["k"], "x", 0.0, 10.0, 1.0, privacy.secure_uniform)
    assert out.columns == ["k", "noisy_n", "noisy_sum", "noisy_avg"] and out.count() == 2
    half = privacy.noisy_sums(df, ["k"], "x", 0.0, 10.0, 1.0, lambda c, i: F.lit(0.5)).where("k = 'a'").first()
    assert (half.noisy_n, half.noisy_sum, half.noisy_avg) == (2.0, 15.0, 7.5)
    with pytest.raises(ValueError):
        privacy.fixed_eps(0)


def test_rollups_are_sums_of_their_parts(spark):
    """Least squares with equal weights: checked against the normal equations; null is a group."""
    import numpy as np

    rows = [("a", "x", 1.0), ("a", "y", 2.0), ("a", "y", None), ("b", "x", 99.0), (None, "z", 3.0), ("c", None, -5.0)]
    df = spark.createDataFrame(rows, "p string, o string, v double")
    draw = lambda c, i: (F.pmod(F.xxhash64(c, F.lit(i)), F.lit(1000)) + 0.5) / 1000.0
    got = privacy.noisy_rollup(df, ["p", "o"], "v", 0.0, 10.0, 6.0, draw).collect()
    assert sorted(r.level for r in got) == [0, 1, 1, 1, 1, 2, 2, 2, 2, 2]
    raw, quiet = ({(r.level, r.p, r.o): r for r in privacy.noisy_rollup(df, ["p", "o"], "v", 0.0, 10.0, e, d).collect()} for e, d in ((6.0, draw), (6.0, lambda c, i: F.lit(0.5))))
    assert {k: r.noisy_sum for k, r in quiet.items()}[0, None, None] == pytest.approx(16.0) and quiet[1, "a", None].noisy_n == pytest.approx(2.0)
    leaves = [k for k in raw if k[0] == 2]
    for name, size in (("noisy_n", 1.0), ("noisy_sum", 10.0)):
        value = {k: getattr(r, name) for k, r in raw.items()}
        assert value[0, None, None] == pytest.approx(sum(value[k] for k in raw if k[0] == 1)) == pytest.approx(sum(value[k] for k in leaves))
        nodes, own = list(raw), []
        paths = {k: json.dumps(list(k[1 : 1 + k[0]]), separators=(",", ":")) for k in nodes}
        us = {r.c: r.u for r in spark.createDataFrame([(x,) for x in paths.values()], "c string").select("c", draw(F.col("c"), int(size > 1)).alias("u")).collect()}
        for k in nodes:
            u = us[paths[k]]
            noise = -size * np.log(2 * (1 - u)) if u >= 0.5 else size * np.log(2 * u)
            own.append(getattr(quiet[k], name) + noise)
        below = np.array([[float(leaf[1 : 1 + k[0]] == k[1 : 1 + k[0]]) for leaf in leaves] for k in nodes])
        best = np.linalg.lstsq(below, np.array(own), rcond=None)[0]
        assert [value[k] for k in leaves] == pytest.approx(best.tolist())


def test_callers():
    assert policy.caller("role:Doctor, dept: Cardio,GUEST") == ["role:doctor", "dept:cardio", "guest"]
    for bad in ("", " , "):
        with pytest.raises(policy.PolicyError):
            policy.caller(bad)
    assert policy.k_of_n(2, policy.parse("a:1"), policy.parse("b:2") | policy.parse("c:3")).min_attrs() == 2


def test_index_and_ask(spark, tmp_path):
    notes = {"a.txt": ("chest pain and cardio", "role:doctor AND dept:cardio"), "b.txt": ("nurse rota for monday", "role:nurse"), "c.txt": ("cardio ward rota", "role:nurse OR dept:cardio")}
    (tmp_path / "docs").mkdir()
    for name, (text, _) in notes.items():
        (tmp_path / "docs" / name).write_text(text)
    (tmp_path / "docs" / "stray.txt").write_text("not in the manifest")
    (tmp_path / "manifest.json").write_text(json.dumps({k: p for k, (_, p) in notes.items()}))
    scheme = ipfe.Scheme.setup(32, 64)
    manifest = ingest.read_manifest(spark, str(tmp_path / "manifest.json"))
    path = str(tmp_path / "chunks")
    ingest.index(scheme, ingest.read_texts(spark, str(tmp_path / "docs"), manifest), KEY, path)
    best = ingest.ask(spark, scheme, KEY, path, "cardio chest pain", ["role:doctor", "dept:cardio"], 5)
    assert [r.doc_id for r in best.orderBy("rank").collect()] == ["a.txt", "c.txt"]
    record = ingest.run_record(str(tmp_path / "run.json"), scheme, ["role:nurse"], "q", best, 0.0, mode="hash")
    assert json.loads((tmp_path / "run.json").read_text()) == record and record["top_k"][0]["score"] > 0.5
    with pytest.raises(Exception, match="missing document"):
        ingest.read_texts(spark, str(tmp_path / "docs"), spark.createDataFrame([("no.txt", "a:b")], "doc_id string, policy string")).collect()
    assert ingest.ask(spark, scheme, KEY, path, "cardio", ["role:visitor"], 5).count() == 0


def run(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_command_line(tmp_path):
    (tmp_path / "docs").mkdir()
    for name, text in (("a.txt", "chest pain after exercise"), ("b.txt", "nurse rota for monday")):
        (tmp_path / "docs" / name).write_text(text)
    (tmp_path / "manifest.json").write_text(json.dumps({"a.txt": "role:doctor", "b.txt": "role:nurse"}))
    (tmp_path / "answer").write_text("He has chest pain.  Give him penicillin.\n")
    args = ["chest pain", "--caller", "role:Doctor", "--docs", "docs", "--manifest", "manifest.json", "--index", "index", "--dim", "16", "--answer", "answer"]
    for times in range(2):
        done = subprocess.run([sys.executable, "-m", "sealedspark", *args], cwd=tmp_path, env=os.environ, capture_output=True, text=True, timeout=200)
        assert done.returncode == 0, done.stderr[-2000:]
        record = json.loads((tmp_path / "run.json").read_text())
        assert [x["doc_id"] for x in record["top_k"]] == ["a.txt"] and record["corpus"] == 2 and record["embedding"] == "hash"
        assert (record["timings"]["ingest_s"] is None) == bool(times) and record["timings"]["rank_ms"] > 0
        assert record["grounding"] == {"fraction": 0.5, "spans": [[20, 40]], "redacted": "He has chest pain.  " + "\u2588" * 20 + "\n"}
        assert "0.500 of the answer" in done.stdout and "a.txt" in done.stdout


def test_a_killed_standing_query_leaves_no_double_rows(spark, tmp_path):
    kind = "query_id long, attrs array<string>, vec array<double>"
    docs = spark.createDataFrame([(i, [float(i), 1.0], "role:nurse" if i % 2 else "role:doctor") for i in range(20)], "doc_id long, vec array<double>, policy string")
    asks = [(i, ["role:nurse"] if i % 3 else ["role:x"], [1.0, float(i)]) for i in range(12)]
    folder, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rank = lambda batch: retrieval.rank_quantized(docs, batch, ["role:nurse", "role:doctor"], 2)
    for part in (asks[:5], asks[5:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)

    def dies_after_writing(batch):
        rank(batch).write.mode("overwrite").parquet(f"{out}/batch=1")
        raise RuntimeError("killed")

    seen = []
    with pytest.raises(Exception, match="killed"):
        run(streaming.answer_requests(stream, lambda b: dies_after_writing(b) if seen else seen.append(1) or rank(b), out, ck))
    run(streaming.answer_requests(stream, rank, out, ck))
    got = sorted(map(tuple, spark.read.parquet(out).select("query_id", "doc_id", "score", "rank").collect()))
    assert got == sorted(map(tuple, rank(spark.createDataFrame(asks, kind)).collect())) and len(got) == 16


def test_beliefs_as_state(spark, tmp_path):
    """Over three batches equal to the batch function; a subject that was silent too long begins anew."""
    kind = "subject long, ms long, tie long, reply string"
    rows = [(i % 4, 1000 + i // 3, i, ["a", "b", "", None, "a", "c"][i % 6]) for i in range(40)]
    folder, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    go = lambda ttl, to, c: run(streaming.write_batches(streaming.beliefs(spark.readStream.schema(kind).parquet(folder), ["a", "b", "c"], {"b": 2.0}, ttl_ms=ttl), to, c))
    for part in (rows[:15], rows[15:30], rows[30:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(folder)
        go(streaming.DAY, out, ck)
    got = {(r.subject, r.round, r.level): r.posterior for r in spark.read.parquet(out).collect()}
    evidence = spark.createDataFrame(rows, kind).withColumn("round", F.expr("row_number() OVER (PARTITION BY subject ORDER BY ms, tie)"))
    want = {(r.subject, r.round, r.level): r.posterior for r in inference.posterior(evidence, ["a", "b", "c"], {"b": 2.0}).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    spark.createDataFrame([(0, 5000, 99, "a"), (1, 1060, 99, "a")], kind).coalesce(1).write.mode("append").parquet(folder)
    go(1000, str(tmp_path / "short"), str(tmp_path / "ck2"))
    last = {(r.subject, r.round) for r in spark.read.parquet(str(tmp_path / "short")).where("round > 10 OR posterior IS NULL OR subject = 0").collect()}
    assert (0, 1) in last and (1, 11) in last and (0, 11) not in last  # 0 was silent too long and begins again, 1 goes on
    with pytest.raises(ValueError):
        streaming.beliefs(spark.createDataFrame([], kind), ["a"])


def test_streamed_redaction_is_once_only(spark, tmp_path):
    kind = "message_id long, arrival long, text string, spans array<struct<start:long,end:long>>"
    first = [(1, 1, "abcdef", [(0, 9)]), (1, 2, "abcdef", [(0, 2)]), (2, 1, "xyz", [(1, 2)])]
    second = [(1, 3, "abcdef", [(3, 4)]), (3, 1, "q", [])]
    folder = str(tmp_path / "in")
    spark.createDataFrame(first, kind).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)
    for rows in (None, second):
        if rows:
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)
        q = streaming.write_with_audit(streaming.redact_once(stream), str(tmp_path / "out"), str(tmp_path / "log"), str(tmp_path / "ck"))
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    out = {(r.message_id, r.arrival): r.redacted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {(1, 2): "██cdef", (2, 1): "x█z", (3, 1): "q"}
    log = {(r.message_id, r.ts): r.refused for r in spark.read.json(str(tmp_path / "log"), schema="message_id long, ts long, refused string").collect()}
    assert log == {(1, 1): "invalid_span", (1, 2): None, (2, 1): None, (3, 1): None}
    batch = grounding.redaction_pass(spark.createDataFrame(first + second, kind)).where("applied").select("message_id", "arrival", "redacted")
    assert {(r.message_id, r.arrival): r.redacted for r in batch.collect()} == out


def test_dates_are_kept(spark):
    assert isinstance(integrity.incidents(spark.createDataFrame([("a", "missing_mac")], "doc_id string, reason string")).first().ts, datetime.datetime)
