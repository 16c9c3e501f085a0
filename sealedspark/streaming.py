"""Standing queries: redaction of messages, each once, beliefs that follow replies, and answers to a stream of requests.

State is kept by key with a time to live, so that it ends with the keys that have fallen silent. Sinks write every batch
into a folder of its own by its number, anew if it is tried again, so that a query that was killed and started again
leaves each row once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sealedspark import grounding

DAY = 24 * 60 * 60 * 1000
_OUT = "message_id long, arrival long, n_spans int, n_chars long, applied boolean, reason string, redacted string"
_BELIEF = "subject long, round long, nth int, level string, posterior double"


def _keyed(rows: DataFrame, key: str, step, out: str, kind: str, ttl_ms: int, late_ms: int) -> DataFrame:
    """`step(key, rows, held)` over a stream (key, ms, ...) by key, which returns output rows, what is held from now on
    (None for nothing) and the last ms; `kind` are the columns held. State goes once the watermark, `late_ms` behind the
    newest row, is `ttl_ms` past it; rows that come later than that are dropped. `ms` are milliseconds since 1970,
    of which the first is late already.
    """
    names = [c.split(" ")[0] for c in out.split(", ")]

    def run(at: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows, held, last = step(at[0], pd.concat(list(parts)).sort_values(["ms", "tie"]), state.get if state.exists else None)
        if held is not None:
            state.update((last, *held))
            state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=names)

    marked = rows.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", f"{late_ms} milliseconds")
    return marked.groupBy(key).applyInPandasWithState(run, out, f"last long, {kind}", "append", GroupStateTimeout.EventTimeTimeout)


def redact_once(messages: DataFrame, ttl_ms: int = 365 * DAY, late_ms: int = 30 * DAY) -> DataFrame:
    """`grounding.redaction_pass` over a stream (message_id, arrival, text, spans): the state is whether a message is done.

    Arrivals (milliseconds) of one message are taken in their order within a batch. A refused pass leaves a message open,
    and no state. A message that comes again more than `ttl_ms` after its last arrival is redacted again. Arrivals that
    are more than `late_ms` older than the newest of earlier batches are dropped.
    """
    n_chars = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    refused = (
        F.when(F.size("spans") > grounding.SPAN_CAP, "span_cap").when(n_chars > grounding.CHAR_CAP, "char_cap")
        .when(~grounding.valid_spans(F.col("text"), F.col("spans")), "invalid_span")
    )
    masked = F.when(refused.isNull(), grounding.redact(F.col("text"), F.col("spans")))
    rows = messages.select("message_id", F.col("arrival").alias("ms"), F.lit(0).alias("tie"), "text", F.size("spans").alias("n_spans"), n_chars.alias("n_chars"), refused.alias("refused"), masked.alias("masked"))

    def step(message: int, rows: pd.DataFrame, held: tuple | None) -> tuple[list, tuple | None, int]:
        last, out = held[0] if held else None, []
        for r in rows.itertuples():
            done = last is not None and r.ms - last <= ttl_ms
            reason = "already_done" if done else r.refused
            out.append((message, r.ms, r.n_spans, r.n_chars, reason is None, reason, r.masked if reason is None else r.text))
            if done or reason is None:
                last = r.ms if last is None else max(last, r.ms)
        return out, None if last is None else (True,), last

    return _keyed(rows, "message_id", step, _OUT, "done boolean", ttl_ms, late_ms)


def beliefs(replies: DataFrame, levels: list[str], prior: dict[str, float] | None = None, q: float = 0.8, p: float = 0.95, ttl_ms: int = 365 * DAY, late_ms: int = 30 * DAY) -> DataFrame:
    """subject, round, nth, level, posterior after every reply of a stream (subject bigint, ms, tie, reply).

    As `inference.posterior`, with the logarithms of a subject's weights as state: the rounds are its replies in the
    order of batches, within one of (ms, tie). Null, empty and unknown replies are evasive here, since one bad row must
    not stop a stream. A subject that has been silent for more than `ttl_ms` begins again with the prior. Replies that
    are more than `late_ms` older than the newest of earlier batches are dropped.
    """
    k = len(levels)
    if k < 2 or set(prior or ()) - set(levels) or not (0 <= p <= 1 and 0 <= q <= 1) or p == q == 1:
        raise ValueError("two levels at least, known ones in the prior, and uncertain replies")
    w = [(prior or {}).get(x, 1.0) for x in levels]
    first = [math.log(x / sum(w)) for x in w]
    evasive, own, other = (math.log(x) for x in (1 / k, q * p + (1 - q) / k, q * (1 - p) / (k - 1) + (1 - q) / k))

    def step(subject: int, rows: pd.DataFrame, held: tuple | None) -> tuple[list, tuple, int]:
        (last, n, logs), out = held or (None, 0, first), []
        for r in rows.itertuples():
            if last is not None and r.ms - last > ttl_ms:
                n, logs = 0, first
            last = r.ms if last is None else max(last, r.ms)
            if r.reply in levels:
                logs = [x + (own if r.reply == level else other) for x, level in zip(logs, levels, strict=True)]
            else:
                logs = [x + evasive for x in logs]
            n += 1
            top = max(logs)
            weight = [math.exp(x - top) for x in logs]
            out += [(subject, n, i, level, x / sum(weight)) for i, (level, x) in enumerate(zip(levels, weight, strict=True))]
        return out, (n, list(logs)), last

    rows = replies.select(F.col("subject").cast("long").alias("subject"), "ms", "tie", "reply")
    return _keyed(rows, "subject", step, _BELIEF, "n long, logs array<double>", ttl_ms, late_ms)


def write_batches(stream: DataFrame, path: str, checkpoint: str, answer: Callable[[DataFrame], DataFrame] = lambda batch: batch, **trigger) -> StreamingQuery:
    """Start a query that writes `answer` of each batch as Parquet below batch=N; a batch that is tried again replaces it."""

    def sink(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def answer_requests(requests: DataFrame, rank: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A standing query service: each batch of a stream of requests (query_id, attrs, and what `rank` needs) is ranked
    against a stored index. `rank` takes a batch as a table, as the functions of `retrieval` do with documents and k
    filled in; what it reads of the index is what the index holds when the batch runs.
    """
    return write_batches(requests, path, checkpoint, rank, **trigger)


def write_with_audit(redacted: DataFrame, path: str, audit_path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that writes redacted messages as Parquet and their audit rows as JSON lines, both below batch=N."""

    def sink(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read twice
        batch.where("applied").select("message_id", "arrival", "redacted").write.mode("overwrite").parquet(f"{path}/batch={number}")
        grounding.audit(batch).write.mode("overwrite").json(f"{audit_path}/batch={number}")
        batch.unpersist()

    return redacted.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
