"""Running usage totals as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.accounting import usage_by_model


def running_totals(usage: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep per-model totals of a usage stream; every batch appends the models it changed.

    State is one row per model.  The table is a log of updates with their batch number, so a batch
    that is run again after a failure rewrites the same rows under the same number.
    """

    def append(changed: DataFrame, batch: int) -> None:
        (changed.withColumn("batch", F.lit(batch).cast("bigint")).coalesce(1)
         .write.mode("overwrite").parquet(f"{path}/batch={batch:012d}"))

    return (usage_by_model(usage).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(append).start())


def current_totals(spark: SparkSession, path: str) -> DataFrame:
    """Latest totals per model from the update log."""
    log = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    values = [c for c in log.columns if c not in ("model", "batch")]
    return log.groupBy("model").agg(F.max_by(F.struct(*values), "batch").alias("v")).select("model", "v.*")


def windowed_totals(usage: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls and tokens per model and tumbling window; state is dropped once the watermark passes."""
    return (usage.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "model")
            .agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
                 F.sum("output_tokens").alias("output_tokens"))
            .select(F.col("w.start").alias("window_start"), "model", "calls", "input_tokens", "output_tokens"))
