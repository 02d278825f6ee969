"""Drift checks as deliveries land in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.drift_watch import Baselines
from ..sources.csv import read_text_table

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
REPORT_SCHEMA = "delivery string, name string, first_run boolean, `column` string, change string, was string, now string"


def watch(spark: SparkSession, landing: str, name: str, baselines: Baselines, log_path: str, checkpoint: str,
          files_per_batch: int = 1_000) -> StreamingQuery:
    """Check every delivery (a subfolder of CSV files) against a named baseline.

    The stream reads only the paths of new files; each delivery found in a batch is then read as a
    table of its own, whatever header it has.  The paths of a batch are bounded by ``files_per_batch``.
    """
    paths = (spark.readStream.schema(FILE_SCHEMA).format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", files_per_batch)
             .load(landing).select("path"))

    def check(batch: DataFrame, number: int) -> None:
        folder = F.regexp_replace("path", r"/[^/]*$", "")
        rows = []
        for row in batch.select(folder.alias("delivery")).distinct().orderBy("delivery").collect():
            # a batch that is run again must not see the baseline its first attempt saved
            report = baselines.check(name, read_text_table(spark, row["delivery"]), origin=f"{log_path}#{number}#{row['delivery']}")
            changes = ([(c, "added", None, None) for c in report.added]
                       + [(c, "removed", None, None) for c in report.removed]
                       + [(c, "type_changed", was, now) for c, was, now in report.type_changed])
            label = row["delivery"].rsplit("/", 1)[-1]
            rows += [(label, name, report.first_run, *c) for c in changes or [(None, "none", None, None)]]
        if rows:
            (spark.createDataFrame(rows, REPORT_SCHEMA).coalesce(1)
             .write.mode("overwrite").parquet(f"{log_path}/batch={number:012d}"))

    return (paths.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(check).start())


def drift_log(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).option("basePath", log_path).parquet(f"{log_path}/batch=*")
