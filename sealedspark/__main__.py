"""python -m sealedspark QUERY --caller "role:Nurse" --docs DIR --manifest FILE --index DIR: index once, then ask."""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import SparkSession

from sealedspark import embedding, ingest, integrity, ipfe, policy, store


def main(args: list[str] | None = None) -> dict:
    ap = argparse.ArgumentParser(prog="sealedspark", description="Authorised retrieval over an encrypted index")
    ap.add_argument("query")
    for name in ("caller", "docs", "manifest", "index"):
        ap.add_argument(f"--{name}", required=True)
    ap.add_argument("-k", type=int, default=5)
    ap.add_argument("--dim", type=int, default=64)
    ap.add_argument("--rebuild", action="store_true")
    ap.add_argument("--record", default="run.json")
    ap.add_argument("--answer", help="a text file: check how much of it rests on the documents found")
    a = ap.parse_args(args)
    spark, began = SparkSession.builder.appName("sealedspark").getOrCreate(), time.perf_counter()
    attrs = policy.caller(a.caller)
    os.makedirs(a.index, exist_ok=True)
    key = integrity.load_key(os.path.join(a.index, "key"))
    scheme = ipfe.load_or_setup(os.path.join(a.index, "scheme.json"), a.dim)
    chunks = os.path.join(a.index, "chunks")
    texts = ingest.read_texts(spark, a.docs, ingest.read_manifest(spark, a.manifest))
    ingest_s = None
    if a.rebuild or not os.path.exists(chunks):
        ingest.index(scheme, texts, key, chunks)
        ingest_s = round(time.perf_counter() - began, 3)
    found = ingest.ask(spark, scheme, key, chunks, a.query, attrs, a.k).persist()
    more = {"corpus": store.list_ids(spark, chunks).count(), "embedding": embedding.mode(None)}
    if a.answer:
        with open(a.answer) as f:
            more["grounding"] = ingest.grounded_answer(f.read(), found, texts)
        print(f"{more['grounding']['fraction']:.3f} of the answer is grounded:\n{more['grounding']['redacted']}")
    record = ingest.run_record(a.record, scheme, attrs, a.query, found, began, ingest_s, **more)
    for r in record["top_k"]:
        print(f"{r['score']:8.4f}  {r['doc_id']}")
    return record


if __name__ == "__main__":
    main()
