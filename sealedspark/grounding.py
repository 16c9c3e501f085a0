"""Grounding of responses in retrieved text, and redaction of what is not grounded."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that ground nothing (fixed values).
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "of", "to", "in", "on", "for",
    "with", "at", "by", "from", "as", "it", "its", "is", "are", "was",
    "were", "be", "been", "being", "this", "that", "these", "those", "not",
    "no", "i", "you", "he", "she", "we", "they", "do", "does", "did",
    "will", "would", "can", "could", "should", "have", "has", "had",
    "there", "then", "than", "so", "about", "into", "over", "under",
    "after", "before", "between", "up", "out",
]
SPAN_CAP, CHAR_CAP, BLOCK = 64, 1024, "█"


def sentences(df: DataFrame) -> DataFrame:
    """`df` (id, text, ...) by sentence: pos, sentence, start, end within the stripped text, one character apart."""
    parts = F.split(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), r"(?U)(?<=[.!?])\s+")
    s = df.select("*", F.posexplode(parts).alias("pos", "sentence")).where("sentence <> ''")
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("sentence") + 1).over(before), F.lit(0)).cast("long")
    return s.withColumn("start", start).withColumn("end", F.col("start") + F.length("sentence")).drop("text")


def content_tokens(text: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0)))
    return F.array_except(words, F.array(*map(F.lit, STOPWORDS)))


def ground(responses: DataFrame, chunks: DataFrame, min_overlap: int = 1) -> DataFrame:
    """Each sentence of `responses` (id, scope, text) and whether a chunk (scope, text) of its scope shares
    `min_overlap` content tokens with it: id, pos, start, end, sentence, grounded."""
    s = sentences(responses)
    words = s.select("id", "scope", "pos", F.explode(content_tokens(F.col("sentence"))).alias("tok"))
    held = chunks.select("scope", F.explode(content_tokens(F.col("text"))).alias("tok")).distinct()
    hits = words.join(held, ["scope", "tok"], "left_semi").groupBy("id", "pos").agg(F.count("*").alias("n"))
    out = s.join(hits, ["id", "pos"], "left")
    return out.select("id", "pos", "start", "end", "sentence", (F.coalesce("n", F.lit(0)) >= min_overlap).alias("grounded"))


def fraction(responses: DataFrame, grounded: DataFrame) -> DataFrame:
    """id, fraction of grounded sentences; 1 for a response without sentences."""
    f = grounded.groupBy("id").agg(F.avg(F.col("grounded").cast("double")).alias("fraction"))
    return responses.select("id").join(f, "id", "left").select("id", F.coalesce("fraction", F.lit(1.0)).alias("fraction"))


def report(responses: DataFrame, grounded: DataFrame) -> DataFrame:
    """id, fraction, spans of every response: its ungrounded sentences in order as (start, end, text)."""
    spans = grounded.where("NOT grounded").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("sentence").alias("text")))).alias("spans"))
    none = F.expr("cast(array() AS array<struct<start:bigint,end:bigint,text:string>>)")
    return fraction(responses, grounded).join(spans, "id", "left").select("id", "fraction", F.coalesce("spans", none).alias("spans"))


def _resolve(text: str | None, spans) -> tuple[list | None, str | None]:
    """The places of span texts in a text, each at or after the end of the one before; else the one that is not there."""
    found = [(m.start(), m.end()) for m in re.finditer(r"\S+", text or "")]
    joined = "\x1f" + "".join(text[a:b] + "\x1f" for a, b in found)
    at, heads = 1, []
    for a, b in found:
        heads.append(at)
        at += b - a + 1
    out, first = [], 0  # the token that a search starts at
    for span in spans:
        words = (span or "").split()
        if not words:
            continue
        needle = "\x1f" + "\x1f".join(words) + "\x1f"
        hit = joined.find(needle, heads[first] - 1) if first < len(heads) else -1
        if hit < 0:
            return None, span
        i = bisect.bisect_left(heads, hit + 1)
        first = i + len(words)
        out.append({"start": found[i][0], "end": found[first - 1][1]})
    return out, None


def resolve_spans(text: Column, spans: Column) -> Column:
    """Where the texts of `spans` (an array of structs with a field text) really stand in a text, whatever its white space.

    A struct of `spans` (start, end; null if one is not there) and `missing` (the first that is not there). Reported
    starts drift where white space is irregular; masking needs these.
    """

    @F.pandas_udf("spans array<struct<start:long,end:long>>, missing string")
    def run(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        rows = [_resolve(t, x if x is not None else []) for t, x in zip(texts, lists, strict=True)]
        return pd.DataFrame({"spans": [r[0] for r in rows], "missing": [r[1] for r in rows]})

    return run(text, F.transform(spans, lambda s: s["text"]))


def norm_ws(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def excerpt(text: Column, n: int = 120) -> Column:
    """The first n characters of a text with its white space made even, and dots if there are more."""
    flat = norm_ws(text)
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


def audit(passes: DataFrame) -> DataFrame:
    """The audit rows of `redaction_pass`: every executed or refused pass, none for one that was done already."""
    kept = passes.where("applied OR reason <> 'already_done'")
    return kept.select("message_id", F.col("arrival").alias("ts"), "n_spans", "n_chars", F.col("reason").alias("refused"))


def valid_spans(text: Column, spans: Column) -> Column:
    """Whether spans (start, end) lie within the text and do not overlap."""
    s = F.array_sort(spans)
    inside = F.forall(s, lambda x: (x["start"] >= 0) & (x["start"] <= x["end"]) & (x["end"] <= F.length(text)))
    apart = F.forall(F.sequence(F.lit(0), F.size(s)), lambda i: F.coalesce(F.get(s, i)["end"] <= F.get(s, i + 1)["start"], F.lit(True)))
    return inside & apart


def redact(text: Column, spans: Column) -> Column:
    """The text with a block for each character of the spans."""
    def mask(t: Column, s: Column) -> Column:
        n = (s["end"] - s["start"]).cast("int")
        return F.when(n == 0, t).otherwise(F.overlay(t, F.repeat(F.lit(BLOCK), n), (s["start"] + 1).cast("int"), n))

    return F.aggregate(F.array_sort(spans), text, mask)


def redaction_pass(messages: DataFrame) -> DataFrame:
    """One pass over `messages` (message_id, arrival, text, spans): applied, reason, redacted.

    The reasons are, in this order, already_done, span_cap, char_cap, invalid_span; else null. A refused
    message is not done, so a later arrival may still be applied.
    """
    n_chars = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    refused = (
        F.when(F.size("spans") > SPAN_CAP, "span_cap").when(n_chars > CHAR_CAP, "char_cap")
        .when(~valid_spans(F.col("text"), F.col("spans")), "invalid_span")
    )
    m = messages.withColumn("refused", refused)
    before = Window.partitionBy("message_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max(F.col("refused").isNull()).over(before), F.lit(False))
    reason = F.when(done, "already_done").otherwise(F.col("refused"))
    m = m.withColumn("reason", reason).withColumn("applied", F.col("reason").isNull())
    text = F.when(F.col("applied"), redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return m.select("message_id", "arrival", F.size("spans").alias("n_spans"), n_chars.alias("n_chars"), "applied", "reason", text.alias("redacted"))
