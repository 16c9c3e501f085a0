"""Audit the answers of conversations: what the other side's messages do not support is masked, and all of it is logged.

    python -m jobs.audit_answers --conversations PATH --out PATH --key PATH [--config PATH]

Input: Parquet files with conv_id, turn, role and text. A turn whose role is `answer_role` is an answer; the other turns
of its conversation are the text that it may rest on. Every sentence that shares fewer than `min_overlap` content words
with these is masked by blocks, unless there are too many of them, too long ones, or they cannot be placed: such answers
stay as they are and say so. Equal rows count once; a null text is an empty answer, which is clean.

Output, below --out, written anew by each run, so that a second run over the same input gives the same files' rows:
  answers/outcome=X   conv_id, turn, fraction, n_spans, n_chars, text; X is clean, redacted, span_cap, char_cap,
                      invalid_span or unresolved
  audit               JSON lines of the passes over answers that had anything to mask
  summary             per outcome a count and the sum of fractions with Laplace noise, for whoever may not see answers.
                      The noise comes from the key and the figures' names: reruns give the same, and nothing to average
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, log_to_stderr, read_config
from sealedspark import grounding, integrity, privacy
from sealedspark.layout import pin

DEFAULTS = {"answer_role": "assistant", "min_overlap": 1, "eps": 1.0}
ANSWERS = "conv_id bigint, turn bigint, fraction double, n_spans int, n_chars bigint, text string, outcome string"


def _uniform(key: bytes):
    """A uniform draw that only the holder of the key can tell, by HMAC of a column and a number."""
    def draw(like, nth: int):
        mac = integrity.mac_udf(key, F.concat(F.lit(f"noise {nth} of "), like))
        return (F.conv(F.substring(mac, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)

    return draw


def audited(turns: DataFrame, conf: dict) -> DataFrame:
    """conv_id, turn, fraction, n_spans, n_chars, text, outcome, spans for every answer in `turns`."""
    t = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    number = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit("")), "text"))
    t = t.withColumn("id", number).withColumn("own", F.coalesce(F.col("role") == conf["answer_role"], F.lit(False)))
    t = t.withColumnRenamed("conv_id", "scope")
    answers, others = pin(t.where("own")), t.where("NOT own").select("scope", "text")
    g = pin(grounding.ground(answers.select("id", "scope", "text"), others, conf["min_overlap"]))
    found = answers.join(grounding.report(answers, g), "id")
    placed = pin(found.withColumn("at", grounding.resolve_spans(F.col("text"), F.col("spans"))))
    none = F.expr("cast(array() AS array<struct<start:bigint,end:bigint>>)")
    messages = placed.select(F.col("id").alias("message_id"), F.col("turn").alias("arrival"), "text", F.coalesce("at.spans", none).alias("spans"))
    passes = grounding.redaction_pass(messages).withColumnRenamed("message_id", "id").drop("arrival")
    outcome = F.when(F.col("at.missing").isNotNull(), "unresolved").when(F.col("n_spans") == 0, "clean").otherwise(F.coalesce("reason", F.lit("redacted")))
    out = placed.select("id", F.col("scope").alias("conv_id"), "turn", "fraction", "at").join(passes, "id")
    return out.select("conv_id", "turn", "fraction", "n_spans", "n_chars", F.col("redacted").alias("text"), outcome.alias("outcome"), F.col("at.spans").alias("spans"))


def read_answers(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(ANSWERS).option("basePath", f"{out}/answers").parquet(f"{out}/answers")


def run(spark: SparkSession, conversations: str, out: str, key: bytes, config: dict | None = None) -> DataFrame:
    """Audit all of `conversations` into `out` and return the answers read back."""
    conf = DEFAULTS | (config or {})
    turns = spark.read.parquet(conversations)
    done = pin(audited(turns, conf))
    done.drop("spans").write.mode("overwrite").partitionBy("outcome").parquet(f"{out}/answers")
    lines = done.where("outcome <> 'clean'").select("conv_id", "turn", "n_spans", "n_chars", "outcome", "spans")
    lines.write.mode("overwrite").json(f"{out}/audit")
    back = read_answers(spark, out)
    u = _uniform(key)
    summary = privacy.noisy_sums(back, ["outcome"], "fraction", 0.0, 1.0, conf["eps"], u)
    summary.coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    n = {r.outcome: r.n for r in back.groupBy("outcome").agg(F.count("*").alias("n")).collect()}  # six rows
    log.info("%s: read %d rows, %d answers: %s", conversations, turns.count(), sum(n.values()), ", ".join(f"{k} {v}" for k, v in sorted(n.items())))
    log.info("wrote %s", ", ".join(f"{out}/{x}" for x in ("answers", "audit", "summary")))
    return back


def main(args: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="audit_answers", description="Mask and log what answers cannot rest on")
    for name in ("conversations", "out", "key"):
        ap.add_argument(f"--{name}", required=True)
    ap.add_argument("--config")
    a = ap.parse_args(args)
    log_to_stderr()
    spark = SparkSession.builder.appName("audit_answers").getOrCreate()
    try:
        config = read_config(spark, a.config, DEFAULTS) if a.config else None
        key = bytes.fromhex(spark.read.text(a.key).first().value.strip())  # 64 hexadecimal digits
        run(spark, a.conversations, a.out, key, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
