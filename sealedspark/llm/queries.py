"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealedspark.llm import bpe, decontaminate, langid, minhash, neighbours, pages, quality, rules, secrets, sentences, sharding, spelling
from sealedspark.llm.common import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = quality.score(docs, table(spark, sf_dir, "labels"))
    return found.select("__doc.doc_id", "perplexity", "threshold", (~F.col("rejected")).alias("kept"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).withColumnRenamed("row", "doc_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_spans(table(spark, sf_dir, "documents")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), limit=1 << 20)


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(100)) == 0)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.dedup(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs, model)
    return found.withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(table(spark, sf_dir, "documents")))


_ALL = [op1_minhash_near_dedup, op2_quality, op3_decontamination, op4_secret_scan, op5_html_extraction, op6_sharding, op7_nn_descent, op8_substring_dedup, op9_language_id, op10_byte_bpe,
        op11_quality_rules, op12_spelling_variants]


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op4_secret_scan": secrets.oracle(), "op11_quality_rules": rules.oracle(), "op12_spelling_variants": spelling.oracle()}
