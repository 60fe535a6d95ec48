"""The log sink and metrics over its stream: windowed counters, a latency histogram and what was dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.errors import InvalidRecord
from millrace.operators.governance import EVENTS, LEVELS
from millrace.operators.redaction import redacted_json

# The histogram's upper bounds in seconds.
LATENCY_BOUNDS = (0.1, 0.25, 0.4, 0.7, 1.0, 1.5, 3.0)

#: A record's fields in the order of their names, as the sink writes them.
FIELDS = ("checkpoint_hash", "deterministic", "error_code", "event", "git_sha", "index_id", "level", "manifest_hash", "payload", "request_id", "run_id", "seed", "ts")
RECORD = "checkpoint_hash string, deterministic boolean, error_code string, event string, git_sha string, index_id string, level string, manifest_hash string, payload variant, request_id string, run_id string, seed long, ts timestamp"


def broken_rule(event: Column, level: Column, error_code: Column) -> Column:
    """The name of the first rule that a record breaks, or null: the event and level lists are closed, an error code is there if and only if the level is error."""
    return (
        F.when(~F.coalesce(event.isin(*EVENTS), F.lit(False)), F.lit("event"))
        .when(~F.coalesce(level.isin(*LEVELS), F.lit(False)), F.lit("level"))
        .when((level == "error") != error_code.isNotNull(), F.lit("error_code"))
    )


def write_log(records: DataFrame, path: str, now: Column | None = None) -> int:
    """Append records as JSON lines with sorted fields, absent ones left out; returns how many were dropped.

    A record that breaks a rule is an error, before anything is written. Payloads (JSON text) are
    redacted on the way; one that is no JSON object cannot be written: it is dropped, counted
    in the same pass, and a closing ``log.dropped`` record tells the count and the last failure.
    """
    spark = records.sparkSession
    here = [f for f in FIELDS if f in records.columns and f != "payload"]
    rule = broken_rule(F.col("event"), F.col("level"), F.col("error_code") if "error_code" in records.columns else F.lit(None).cast("string"))
    broken = records.select("event", "level", rule.alias("rule")).where("rule IS NOT NULL").limit(1).collect()
    if broken:
        raise InvalidRecord(f"{broken[0]['rule']}: event {broken[0]['event']!r} at level {broken[0]['level']!r}")
    stamp = now if now is not None else F.current_timestamp()
    own = records if "ts" in records.columns else records.withColumn("ts", stamp)
    here = [f for f in FIELDS if f in own.columns and f != "payload"]
    payload = F.col("payload") if "payload" in own.columns else F.lit(None).cast("string")
    own = own.select(*here, F.coalesce(payload, F.lit("{}")).alias("_payload"))
    own = own.withColumn("_ok", F.coalesce(F.schema_of_variant(F.try_parse_json("_payload")).startswith("OBJECT"), F.lit(False)))
    seen = Observation()
    own = own.observe(seen, F.count_if(~F.col("_ok")).alias("dropped"), F.max(F.when(~F.col("_ok"), F.substring("_payload", 1, 80))).alias("last"))
    written = own.withColumn("payload", F.try_parse_json(redacted_json("_payload", "level"))).where("_ok")
    _lines(written, here).write.mode("append").text(path)
    counts = seen.get
    if counts["dropped"]:
        text = F.to_json(F.struct(F.lit(counts["dropped"]).alias("count"), F.lit(f"no JSON object: {counts['last']}").alias("last_failure")))
        closing = spark.range(0, 1, 1, 1).select(stamp.alias("ts"), F.lit("warn").alias("level"), F.lit("log.dropped").alias("event"), F.parse_json(text).alias("payload"))
        _lines(closing, ["event", "level", "ts"]).write.mode("append").text(path)
    return counts["dropped"]


def _lines(records: DataFrame, fields: list[str]) -> DataFrame:
    whole = [f for f in FIELDS if f in fields or f == "payload"]
    return records.select(F.to_json(F.struct(*whole), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"}).alias("value"))


def histogram(seconds: Column, bounds: tuple[float, ...] = LATENCY_BOUNDS) -> Column:
    """Cumulative counts of an aggregate: how many values lie at or below each bound, and how many there are."""
    return F.array(*[F.count_if(seconds <= b) for b in bounds], F.count(seconds))


def log_metrics(stream: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """(start, event, n, total_seconds, buckets) of each window and event of a stream of (ts, event, seconds).

    The watermark follows the latest ts by ``lateness``; rows of windows that it has passed are
    dropped, so the state holds the open windows only. Counters and buckets are sums, merged on
    the map side: a common event does not fill a task.
    """
    timed = stream.withWatermark("ts", lateness)
    return (
        timed.groupBy(F.window("ts", width), "event")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("total_seconds"), histogram(F.col("seconds")).alias("buckets"))
        .select(F.col("window.start").alias("start"), "event", "n", "total_seconds", "buckets")
    )


def run_metrics(spark: SparkSession, source: str, out: str, checkpoint: str, width: str = "1 hour", lateness: str = "2 hours", files_a_batch: int = 1) -> StreamingQuery:
    """Follow a folder of (ts, event, seconds) Parquet files: the windows that a batch changed go to out/batch=N.

    A batch done again writes the same folder again, so nothing counts twice; ``current`` reads
    each window's last state.
    """

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream = spark.readStream.schema("ts timestamp, event string, seconds double").option("maxFilesPerTrigger", files_a_batch).parquet(source)
    query = log_metrics(stream, width, lateness).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each window and event that was written."""
    schema = "start timestamp, event string, n long, total_seconds double, buckets array<long>, batch long"
    rows = spark.read.schema(schema).parquet(out)
    last = F.max_by(F.struct("n", "total_seconds", "buckets"), "batch")
    return rows.groupBy("start", "event").agg(last.alias("_r")).select("start", "event", "_r.*")


def dropped(source: DataFrame, metrics: DataFrame) -> DataFrame:
    """(event, read, counted, dropped): rows of the source that no window counted, since they came after the watermark."""
    read = source.groupBy("event").agg(F.count(F.lit(1)).alias("read"))
    counted = metrics.groupBy(F.col("event").alias("_e")).agg(F.sum("n").alias("_n"))
    joined = read.join(counted, F.col("event").eqNullSafe(F.col("_e")), "left")
    n = F.coalesce("_n", F.lit(0))
    return joined.select("event", "read", n.alias("counted"), (F.col("read") - n).alias("dropped"))
