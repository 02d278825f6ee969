"""Structured Streaming jobs and their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.drift_watch import Baselines
from ..registry import operation
from ..session import work_path
from ..sources import csv
from ..sources.tables import fixture, table
from ..streaming import drift_stream, payloads, ttl_cache, usage
from .drift import BOTH, DIFF, FEEDS

_ENVELOPES = """
SELECT event_id, CASE WHEN octet_length(encode(body)) > 1048576 THEN 'too_large' WHEN body = '' THEN 'empty'
    WHEN NOT json_valid(body) THEN 'raw' WHEN json_type(body) = 'OBJECT' THEN 'object' ELSE 'payload' END AS kind,
  CASE WHEN octet_length(encode(body)) > 1048576 THEN NULL WHEN body = '' THEN '{}'
    WHEN NOT json_valid(body) THEN CAST(json_object('raw', body) AS varchar)
    WHEN json_type(body) = 'OBJECT' THEN body ELSE '{"payload":' || body || '}' END AS envelope FROM payloads"""


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables as a stream of files."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _payload_stream(events: DataFrame) -> DataFrame:
    n = F.col("event_id") % 11
    return events.select("event_id", F.when(n == 0, "{bad").when(n == 1, "[1,2]").when(n == 2, "")
                         .otherwise(F.col("props")).alias("body"))


@operation("STR-1", uses=["payloads"], sql=_ENVELOPES)
def payload_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Event payloads wrapped as JSON objects, in batch."""
    return payloads.envelopes(fixture(spark, sf, "payloads"))


@operation("STR-1", uses=["payloads"], sql=_ENVELOPES)
def payload_envelopes_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Event payloads wrapped as JSON objects, as a stream."""
    path = work_path(spark, "envelopes")
    payloads.write_stream(_payload_stream(_stream(spark, sf, "events")), path,
                          work_path(spark, "envelopes-progress")).awaitTermination()
    return spark.read.schema("event_id bigint, kind string, envelope string").parquet(path)


def _usage_stream(events: DataFrame) -> DataFrame:
    n = F.col("event_id")
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("model-"), "event_type").alias("model"),
                         (n % 5000 + 100).alias("input_tokens"), (n % 700 + 10).alias("output_tokens"),
                         (n % 90).alias("cache_read"), (n % 40).alias("cache_write"))


@operation("STR-3", uses=["usage_log"], sql="""
SELECT model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read) AS BIGINT) AS cache_read,
  CAST(sum(cache_write) AS BIGINT) AS cache_write FROM usage_log GROUP BY model""")
def running_usage_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Running usage totals per model, as a stream."""
    path = work_path(spark, "running-usage")
    usage.running_totals(_usage_stream(_stream(spark, sf, "events")), path,
                         work_path(spark, "running-usage-progress")).awaitTermination()
    return usage.current_totals(spark, path)


@operation("STR-3", uses=["usage_log"], sql="""
SELECT CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS window_us, model, count(*) AS calls,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens
FROM usage_log GROUP BY 1, 2""")
def hourly_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Usage per model and hour; the batch twin of the windowed stream."""
    usage_log = _usage_stream(table(spark, sf, "events"))
    return usage.windowed_totals(usage_log).select(F.unix_micros("window_start").alias("window_us"), "model", "calls",
                                                   "input_tokens", "output_tokens")


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "requests").select(
        "event_id", "request_key", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))


_MISSES = """
WITH RECURSIVE r AS (SELECT event_id, CAST(user_id % 20 AS varchar) || '-' || event_type AS request_key, ts FROM events),
m AS (SELECT request_key, min(ts) AS t FROM r GROUP BY 1
  UNION ALL
  SELECT request_key, t FROM (SELECT m.request_key, (SELECT min(r.ts) FROM r WHERE r.request_key = m.request_key
     AND r.ts > m.t + INTERVAL 3600 SECOND) AS t FROM m) WHERE t IS NOT NULL),
first AS (SELECT request_key, ts, min(event_id) AS event_id FROM r GROUP BY 1, 2),
misses AS (SELECT event_id FROM first JOIN m ON first.request_key = m.request_key AND first.ts = m.t)
SELECT event_id, request_key, event_id IN (SELECT event_id FROM misses) AS is_miss FROM r"""


@operation("STR-4", sql=_MISSES)
def cache_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Hit or miss of every request under a one-hour lifetime, in batch."""
    return ttl_cache.classify(_requests(spark, sf)).select("event_id", "request_key", "is_miss")


@operation("STR-4", sql=_MISSES)
def cache_outcomes_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Hit or miss of every request under a one-hour lifetime, as a stream."""
    events = _stream(spark, sf, "events")
    requests = events.select("event_id", F.concat((F.col("user_id") % 20).cast("string"), F.lit("-"), "event_type")
                             .alias("request_key"), F.col("ts").cast("timestamp").alias("ts"))
    path = work_path(spark, "cache")
    (ttl_cache.classify_stream(requests).writeStream.format("parquet").option("path", path)
     .option("checkpointLocation", work_path(spark, "cache-progress")).outputMode("append")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema("event_id bigint, request_key string, is_miss boolean").parquet(path)


@operation("STR-2 SRC-1", uses=FEEDS, sql=BOTH + f"""
SELECT 'delivery-1' AS delivery, 'parts feed' AS name, TRUE AS first_run, CAST(NULL AS varchar) AS column_name, 'none' AS change
UNION ALL SELECT 'delivery-2', 'parts feed', FALSE, column_name, change FROM ({DIFF})""")
def drift_stream_log(spark: SparkSession, sf: str) -> DataFrame:
    """Drift reports of two CSV deliveries of the parts feed landing in a watched folder."""
    landing, log = work_path(spark, "landing"), work_path(spark, "drift-log")
    for i, feed in enumerate(("feed_v1", "feed_v2"), 1):
        csv.write_table(fixture(spark, sf, feed), f"{landing}/delivery-{i}")
    baselines = Baselines(spark, work_path(spark, "baselines"))
    drift_stream.watch(spark, landing, "parts feed", baselines, log, work_path(spark, "drift-progress")).awaitTermination()
    return drift_stream.drift_log(spark, log).select("delivery", "name", "first_run",
                                                     F.col("column").alias("column_name"), "change")
