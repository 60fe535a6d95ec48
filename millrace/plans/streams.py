"""Streams over the tables: incremental dedup, log metrics and the log sink. Each feeds a table in files, with a restart midway."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.session import shared_dir, table
from millrace.streaming import dedup, logs

SLICES = 6
#: Files of a batch: all of a slice, which is taken in before the next one is written.
ALL_FILES = 1 << 20


def _fresh(spark, name):
    return f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"


def _fed(rows, slice_, folder):
    """A function that writes slice i of the rows into a folder, as each task's own files, and each after the one before."""

    def feed(i):
        rows.where(slice_ == i).write.mode("append").parquet(folder)

    return feed


@query(
    "stream_d1_dedup",
    """SELECT doc_id AS seq, doc_id = min(doc_id) OVER same AS kept, min(doc_id) OVER same AS kept_seq FROM documents WINDOW same AS (PARTITION BY coalesce(sha256(text), ''))""",
)
def incremental_dedup(spark, sf_dir):
    """documents in six slices by doc_id; the stream stops after each and goes on from its checkpoint with the next."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    most = docs.agg(F.max("doc_id")).first()[0] or 0
    source, out, checkpoint = (_fresh(spark, n) for n in ("slices", "decided", "offsets"))
    feed = _fed(docs, F.floor(F.col("doc_id") * SLICES / F.lit(most + 1)), source)
    for i in range(SLICES):
        feed(i)
        dedup.run_dedup(spark, source, "doc_id long, text string", "text", "doc_id", out, checkpoint, files_a_batch=ALL_FILES)
    return spark.read.schema("seq long, kept boolean, kept_seq long").parquet(out)


# every 37th event comes two files late; a file holds events of about a sixth of the time
_FILE = "least(5, (event_id * 6) // (SELECT count(*) FROM events) + CASE WHEN event_id % 37 = 0 THEN 2 ELSE 0 END)"
_LATE = f"""WITH e AS (SELECT event_type AS event, date_trunc('hour', ts) AS start, ts, value / 40 AS seconds, {_FILE} AS file FROM events WHERE ts IS NOT NULL),
    seen AS (SELECT file, max(max(ts)) OVER (ORDER BY file) - INTERVAL 2 HOUR AS mark FROM e GROUP BY file),
    rows AS (SELECT e.*, start + INTERVAL 1 HOUR <= (SELECT max(mark) FROM seen WHERE seen.file < e.file) AS late FROM e)"""


def _metrics(spark, sf_dir):
    """(rows fed, metrics so far) after all files: the stream is stopped and started again after each, so the watermark of a file is that of all before."""
    e = table(spark, sf_dir, "events").where(F.col("ts").isNotNull())
    n = e.sparkSession.read.parquet(f"{sf_dir}/events.parquet").count()
    at = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts").cast("timestamp_ntz")).cast("timestamp")
    file = F.least(F.lit(5), F.floor(F.col("event_id") * 6 / n) + F.when(F.col("event_id") % 37 == 0, 2).otherwise(0))
    rows = e.select(at.alias("ts"), F.col("event_type").alias("event"), (F.col("value") / 40).alias("seconds"), file.alias("_file"))
    source, out, checkpoint = (_fresh(spark, n) for n in ("log", "windows", "offsets"))
    feed = _fed(rows.select("ts", "event", "seconds", "_file"), F.col("_file"), source)
    for i in range(6):
        feed(i)
        logs.run_metrics(spark, source, out, checkpoint, files_a_batch=ALL_FILES)
    return spark.read.schema("ts timestamp, event string, seconds double").parquet(source), logs.current(spark, out)


@query(
    "stream_k10_windows",
    _LATE
    + """ SELECT start, event, count(*) AS n, round(sum(seconds), 6) AS total_seconds, count(*) FILTER (seconds <= 0.1) AS le_100_ms, count(*) FILTER (seconds <= 0.7) AS le_700_ms, count(*) FILTER (seconds <= 3.0) AS le_3_s, count(seconds) AS le_any
          FROM rows WHERE NOT coalesce(late, false) GROUP BY ALL""",
)
def windows(spark, sf_dir):
    """Events as log records, their value as a latency: hourly counters and the histogram, late rows dropped."""
    _, found = _metrics(spark, sf_dir)
    b = F.col("buckets")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event", "n", F.round("total_seconds", 6).alias("total_seconds"), b[0].alias("le_100_ms"), b[3].alias("le_700_ms"), b[6].alias("le_3_s"), b[7].alias("le_any"))


@query("stream_k10_dropped", _LATE + " SELECT event, count(*) AS read, count(*) FILTER (NOT coalesce(late, false)) AS counted, count(*) FILTER (late) AS dropped FROM rows GROUP BY event")
def dropped(spark, sf_dir):
    """What came too late, by event."""
    source, found = _metrics(spark, sf_dir)
    return logs.dropped(source, found)


@query(
    "sink_k10_log",
    """WITH r AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'train.step' ELSE 'inference.success' END AS event, CASE WHEN value > 90 THEN 'error' ELSE 'info' END AS level,
              CASE WHEN value > 90 THEN 'E' || event_id END AS error_code, props, event_id % 50 = 0 AS bad FROM events)
       SELECT event, level, error_code, (props->>'k')::BIGINT AS k, NULL::BIGINT AS count, event_id AS seed FROM r WHERE NOT bad
       UNION ALL SELECT 'log.dropped', 'warn', NULL, NULL, (SELECT count(*) FROM r WHERE bad), NULL WHERE EXISTS (SELECT 1 FROM r WHERE bad)""",
)
def log_sink(spark, sf_dir):
    """Events written as log records and read again: every fiftieth has no JSON for payload, is dropped and counted."""
    bad = F.col("event_id") % 50 == 0
    records = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "view", "train.step").otherwise("inference.success").alias("event"),
        F.when(F.col("value") > 90, "error").otherwise("info").alias("level"),
        F.when(F.col("value") > 90, F.concat(F.lit("E"), F.col("event_id").cast("string"))).alias("error_code"),
        F.when(bad, F.lit("{no json")).otherwise(F.col("props")).alias("payload"),
        F.col("event_id").alias("seed"),
    )
    path = _fresh(spark, "log-sink")
    logs.write_log(records, path)
    rows = spark.read.schema("event string, level string, error_code string, payload struct<k: bigint, count: bigint>, seed long").json(path)
    return rows.select("event", "level", "error_code", F.col("payload.k").alias("k"), F.col("payload.count").alias("count"), "seed")
