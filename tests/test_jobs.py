import hashlib
import json
import os
import subprocess
import sys

import pytest
from oracle import compare
from pyspark.sql import functions as F

from jobs import audit_answers, ingest_documents, queries
from jobs.common import read_config
from sealedspark import embedding, grounding, integrity, policy_rows, retrieval

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
KEY = bytes(range(32))
CONF = {"policies": {"en": "role:nurse", "de": "role:doctor AND dept:cardio"}}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, folder, name, rows):
    """One more Parquet file in a folder, written aside and moved in, as a loader would."""
    spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in rows], DOCS).coalesce(1).write.parquet(f"{folder}-{name}")
    part = next(x for x in os.listdir(f"{folder}-{name}") if x.startswith("part-"))
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{folder}-{name}/{part}", f"{folder}/{name}.parquet")


def state(df):
    return {r.doc_id: (r.version, r.digest, r.policy, r.lang, r.source, r.n_words) for r in df.collect()}


def entry(version, text, lang, source):
    return version, hashlib.sha256(text.encode()).hexdigest(), CONF["policies"].get(lang), lang or None, source, len(text.split())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_oracle(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name], "/root/testdata/sf0.001")


def first_rows():
    return [(i, f"Text {i} of the ward " * (i % 4 + 1), ("en", "de", "fr", "", None)[i % 5], f"s{i}") for i in range(40)]


def later_rows():
    rows = [(i, f"new {i}", "en", "n") for i in range(100, 110)] + [(i, f"other text {i}", "de", "c") for i in range(5)]
    rows += [first_rows()[i] for i in range(10, 13)] + [(20, None, "en", "x"), (999, None, "en", "x"), (None, "nameless", "en", "x")]
    return [*rows, (150, "a first", "en", "x"), (150, "a second", "en", "x"), (151, "twice", "en", "x"), (151, "twice", "en", "x"), (152, "", "en", None)]


def expected():
    want = {i: entry(1, t, lang, s) for i, t, lang, s in first_rows() if i != 20}
    want |= {i: entry(2 if i < 5 else 1, t, lang, s) for i, t, lang, s in later_rows() if i is not None and t is not None and not 10 <= i < 13 and i < 150}
    second = max(("a first", "a second"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    return want | {150: entry(1, second, "en", "x"), 151: entry(1, "twice", "en", "x"), 152: entry(1, "", "en", None)}


def test_two_runs_over_a_growing_folder(spark, tmp_path):
    docs, out, ck = str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "ck")
    put(spark, docs, "one", first_rows())
    go = lambda: ingest_documents.run(spark, docs, out, ck, KEY, CONF)
    assert state(go()) == {i: entry(1, t, lang, s) for i, t, lang, s in first_rows()}
    put(spark, docs, "two", later_rows())
    got = go()
    assert state(got) == expected() and got.count() == len(expected())
    report = {r.what: r.n for r in spark.read.json(f"{out}/report/batch=1").collect()}
    assert report == {"rows": len(later_rows()), "without doc_id": 1, "new": 13, "changed": 5, "same": 3, "withdrawn": 1, "unknown": 1}
    before = sorted(os.listdir(f"{out}/index"))
    assert state(go()) == expected() and sorted(os.listdir(f"{out}/index")) == before
    # only what was new or changed was embedded, and the vectors are those of the library's embedder
    assert spark.read.parquet(f"{out}/index/batch=1").count() == 18
    v = {r.doc_id: r.vec for r in got.collect()}
    want = embedding.embed_texts(["other text 3", ""], 64)
    assert v[3] == [round(x * 100) for x in want[0]] and v[152] == [0] * 64
    # withdrawn and come back: a version further
    put(spark, docs, "three", [(20, "again", "en", "x")])
    assert state(go())[20] == entry(3, "again", "en", "x")
    # the index serves authorised search as it is
    asks = spark.createDataFrame([(1, ["role:nurse"], [float(x) for x in v[3]]), (2, ["role:doctor", "dept:cardio"], [float(x) for x in v[3]])], "query_id long, attrs array<string>, vec array<double>")
    held = got.select("doc_id", "policy", F.col("vec").cast("array<double>").alias("vec"))
    best = {r.query_id: r.doc_id for r in retrieval.rank_quantized(held, asks, held, 1).collect()}
    assert best[2] == 3 and best[1] != 3 and policy_rows.quarantine(held).count() == 0


def test_compaction_goes_on_with_the_same_checkpoint(spark, tmp_path):
    docs, out, new, ck = (str(tmp_path / x) for x in ("docs", "out", "new", "ck"))
    for name, rows in (("one", first_rows()), ("two", later_rows())):
        put(spark, docs, name, rows)
        ingest_documents.run(spark, docs, out, ck, KEY, CONF)
    with pytest.raises(ValueError):
        ingest_documents.compact(spark, str(tmp_path / "none"), new)
    ingest_documents.compact(spark, out, new)
    assert state(ingest_documents.current(spark, new)) == expected() == state(ingest_documents.current(spark, out))
    assert [x for x in os.listdir(f"{new}/index") if x.startswith("batch")] == ["batch=1"]
    assert spark.read.parquet(f"{new}/index").count() == len(expected())
    put(spark, docs, "three", [(20, "again", "en", "x"), (0, "third text", "de", "c")])
    got = state(ingest_documents.run(spark, docs, new, ck, KEY, CONF))
    assert got == expected() | {20: entry(3, "again", "en", "x"), 0: entry(3, "third text", "de", "c")}


@pytest.mark.parametrize("where", ["_verify", "log"])
def test_a_batch_that_fails_is_taken_again_once(spark, tmp_path, monkeypatch, where):
    """The run dies before the ledger, or after it but before the checkpoint knows: the next one gives the same."""
    docs, out, ck = str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "ck")
    put(spark, docs, "one", first_rows())
    ingest_documents.run(spark, docs, out, ck, KEY, CONF)
    put(spark, docs, "two", later_rows())

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(ingest_documents if where == "_verify" else ingest_documents.log, "_verify" if where == "_verify" else "info", die)
        with pytest.raises(Exception, match="killed"):
            ingest_documents.run(spark, docs, out, ck, KEY, CONF)
    if where == "_verify":
        assert state(ingest_documents.current(spark, out)) == {i: entry(1, t, lang, s) for i, t, lang, s in first_rows()}
    got = ingest_documents.run(spark, docs, out, ck, KEY, CONF)
    assert state(got) == expected() and got.count() == len(expected())


def test_what_was_written_is_checked(spark, tmp_path, monkeypatch):
    docs, out, ck = str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "ck")
    put(spark, docs, "one", first_rows())
    seal = integrity.seal
    monkeypatch.setattr(integrity, "seal", lambda rows, key: seal(rows, key).withColumn("n_words", F.lit(7).cast("long")).withColumn("source", F.lit("moved")))
    with pytest.raises(Exception, match="mac_mismatch"):
        ingest_documents.run(spark, docs, out, ck, KEY, CONF)
    assert ingest_documents.current(spark, out).count() == 0


def test_settings(spark, tmp_path):
    for job in (ingest_documents, audit_answers):
        name = job.__name__.split(".")[1]
        assert read_config(spark, f"{ROOT}/jobs/{name}.json", job.DEFAULTS).keys() == job.DEFAULTS.keys()
    (tmp_path / "bad.json").write_text(json.dumps({"dims": 3}))
    with pytest.raises(ValueError, match="dims"):
        read_config(spark, str(tmp_path / "bad.json"), ingest_documents.DEFAULTS)
    with pytest.raises(ValueError):
        ingest_documents.run(spark, str(tmp_path), "", "", KEY, {"policies": {"en": "((("}})


TURNS = "conv_id long, turn long, role string, text string, id long, scope string"


def turns():
    many = " ".join(f"Zebra {i}." for i in range(70))
    rows = [
        (1, 1, "user", "The ward takes aspirin."), (1, 2, "assistant", "  Give aspirin now.\n\nCall  mother! The end."), (1, 3, "assistant", None), (1, 4, "assistant", "Ward."),
        (2, 1, "user", None), (2, 2, "assistant", many), (2, 3, "assistant", "long " * 300 + "."), (2, 4, "tool", "zebra"), (None, 5, "assistant", "Nobody said so."), (3, None, None, "x"),
    ]
    return [(*r, 1, "s") for r in rows + [rows[1], rows[1]]]


def test_audit(spark, tmp_path):
    src, out = str(tmp_path / "c"), str(tmp_path / "out")
    spark.createDataFrame(turns(), TURNS).write.parquet(src)
    first = sorted(map(str, audit_answers.run(spark, src, out, KEY).collect()))
    noise = sorted(map(str, spark.read.json(f"{out}/summary").collect()))
    got = {(r.conv_id, r.turn): r for r in audit_answers.run(spark, src, out, KEY).collect()}
    assert sorted(map(str, audit_answers.read_answers(spark, out).collect())) == first and len(first) == 6
    assert sorted(map(str, spark.read.json(f"{out}/summary").collect())) == noise
    b = grounding.BLOCK
    assert (got[1, 2].outcome, got[1, 2].text, got[1, 2].n_spans) == ("redacted", f"  Give aspirin now.\n\n{b * 13} {b * 8}", 2)
    assert {k: r.outcome for k, r in got.items()} == {(1, 2): "redacted", (1, 3): "clean", (1, 4): "clean", (2, 2): "clean", (2, 3): "char_cap", (None, 5): "redacted"}
    assert got[2, 3].text == "long " * 300 + "." and got[1, 3].fraction == 1.0
    lines = spark.read.json(f"{out}/audit").collect()
    assert {(r.conv_id, r.turn, r.outcome) for r in lines} == {(1, 2, "redacted"), (2, 3, "char_cap"), (None, 5, "redacted")}
    strict = {(r.conv_id, r.turn): r.outcome for r in audit_answers.run(spark, src, out, KEY, {"min_overlap": 2}).collect()}
    assert strict[2, 2] == "span_cap" and len(strict) == 6
    spark.createDataFrame([], TURNS).write.parquet(str(tmp_path / "none"))
    assert audit_answers.run(spark, str(tmp_path / "none"), str(tmp_path / "o2"), KEY).count() == 0


def test_command_lines(spark, tmp_path):
    docs, key = str(tmp_path / "docs"), tmp_path / "key"
    put(spark, docs, "one", first_rows())
    key.write_text(KEY.hex() + "\n")
    spark.createDataFrame(turns(), TURNS).write.parquet(str(tmp_path / "c"))
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_CONF_DIR": str(tmp_path)}
    common = ["--out", str(tmp_path / "out"), "--key", str(key)]
    for args in (["jobs.ingest_documents", "--docs", docs, "--checkpoint", str(tmp_path / "ck"), *common, "--config", f"{ROOT}/jobs/ingest_documents.json", "--compact-to", str(tmp_path / "compact")],
                 ["jobs.audit_answers", "--conversations", str(tmp_path / "c"), *common]):
        done = subprocess.run([sys.executable, "-m", *args], cwd=str(tmp_path), env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and "read" in done.stderr and "wrote" in done.stderr, done.stderr[-2000:]
    assert all(ingest_documents.current(spark, str(tmp_path / x)).count() == 40 for x in ("out", "compact"))


def test_jobs_do_not_load_the_training_data_operators():
    code = "import sys, jobs.queries; assert not [m for m in sys.modules if m.startswith('sealedspark.llm') or m == 'corpus_pipeline']"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
