"""Payload envelopes, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import payload as pl


def envelopes(payloads: DataFrame) -> DataFrame:
    """(event_id, kind, envelope); a stateless projection, so it also runs on a stream."""
    kinds = payloads.select("event_id", "body", pl.payload_kind(F.col("body")).alias("kind"))
    return kinds.select("event_id", "kind", pl.envelope(F.col("body"), F.col("kind")).alias("envelope"))


def write_stream(payloads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the envelopes of a stream to a Parquet table and stop when the input is used up."""
    return (envelopes(payloads).writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
