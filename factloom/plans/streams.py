"""Streaming jobs fed from the given tables and read back when all input is taken in."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import blocks
from factloom.plans import texts  # noqa: F401  its checks are used here
from factloom.plans.coverage import _CODE, _RUNS, _STAGE, _STATE, _runs
from factloom.plans.registry import ORACLE, query
from factloom.session import scratch_path
from factloom.streaming import jobs


def _stream(t, table: str):
    """A table as a stream, be it one file or a folder of files: by a pattern that only its name fits, as a stream takes no single file by its plain path."""
    schema = getattr(t, table).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{{{table}}}.parquet")


def _events(t):
    return _stream(t, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("streamed_admission", """
SELECT user_id, CAST(date_trunc('minute', ts) AS STRING) AS minute, count(*) AS n, greatest(0, count(*) - 1) AS over FROM events GROUP BY 1, 2""")
def streamed_admission(t):
    out = scratch_path(t.spark, "admission")
    jobs.stream_admission(_events(t), "user_id", "at", out, scratch_path(t.spark, "ckpt"), 1).awaitTermination()
    return jobs.read_admission(t.spark, out, "user_id").select(
        "user_id", F.date_format("minute", "yyyy-MM-dd HH:mm:ss").alias("minute"), "n", F.col("over").cast("long").alias("over"))


@query("streamed_decisions", """
WITH m AS (SELECT event_id, event_type, date_trunc('day', ts) AS day FROM events),
u AS (SELECT *, row_number() OVER (PARTITION BY event_type, day ORDER BY event_id) AS k FROM m),
p AS (SELECT event_id, row_number() OVER (PARTITION BY day ORDER BY event_id) AS o FROM u WHERE k <= 4)
SELECT u.event_id, CASE WHEN k > 4 THEN 'user_limit' WHEN o <= 10 THEN 'admitted' ELSE 'overall_limit' END AS tier,
  CASE WHEN k > 4 OR o > 10 THEN 60 END AS retry_after FROM u LEFT JOIN p USING (event_id)""")
def streamed_decisions(t):
    """The events of a day as if in one minute and their kinds as users, so that both limits are reached."""
    out = scratch_path(t.spark, "decisions")
    events = _events(t).selectExpr("event_id", "event_type AS who", "date_trunc('day', at) AS at")
    jobs.stream_decisions(events, "who", "at", "event_id", out, scratch_path(t.spark, "seen"), scratch_path(t.spark, "ckpt"), 4, 10).awaitTermination()
    return t.spark.read.parquet(out).select("event_id", "tier", "retry_after")


@query("streamed_answers", "SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS sent FROM events GROUP BY 1, 2")
def streamed_answers(t):
    """Drafts at the times of the events, which lie days apart, sent twice over: each key is stored once, with its first time."""
    out = scratch_path(t.spark, "answers")
    for _ in range(2):
        drafts = _events(t).select("user_id", "event_type", F.col("at").alias("sent"))
        jobs.stream_answers(drafts, ["user_id", "event_type"], "sent", out, scratch_path(t.spark, "ckpt")).awaitTermination()
    return jobs.read_merged(t.spark, out).select("user_id", "event_type", F.date_format("sent", "yyyy-MM-dd HH:mm:ss").alias("sent"))


@query("streamed_blocks", ORACLE["text_chunks"])
def streamed_blocks(t):
    """The documents as a stream, in blocks: the same as the blocks of the table."""
    out = scratch_path(t.spark, "blocks")
    texts = _stream(t, "documents").select("doc_id", blocks.normalise_text(F.col("text")).alias("text"))
    jobs.stream_chunks(texts, ["doc_id"], out, scratch_path(t.spark, "ckpt")).awaitTermination()
    stored = t.spark.read.schema("doc_id bigint, block_ord int, start int, stop int, line_start int, text string").parquet(out)  # also where no block was written
    b = blocks.located(stored)
    return b.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("start", "stop", "line_start", "line_end")], "text_hash")


@query("streamed_coverage", f"""
WITH f AS (SELECT user_id AS run_id, event_id, {_STATE} AS status, {_CODE} AS code FROM events), r AS ({_RUNS})
SELECT r.run_id, discovered, count_if(status = 'ready') AS ready, count_if(status = 'capped') AS capped, count_if(code = 'timeout') AS failed FROM r JOIN f USING (run_id) GROUP BY 1, 2""")
def streamed_coverage(t):
    changes = _stream(t, "events").selectExpr(
        "user_id AS run_id", "event_id AS file_id", f"{_STATE} AS status", f"{_CODE} AS error_code", f"{_STAGE} AS error_stage").selectExpr(
        "run_id", "file_id", "inline(array(struct(1 AS seq, 'discovered' AS status, CAST(NULL AS STRING) AS error_code, CAST(NULL AS STRING) AS error_stage), "
        "struct(2 AS seq, status, error_code, error_stage)))")
    out = scratch_path(t.spark, "states")
    jobs.stream_states(changes, out, scratch_path(t.spark, "ckpt")).awaitTermination()
    return jobs.stream_coverage(t.spark, out, _runs(t)).select("run_id", "discovered", "ready", "capped", "failed")


