"""Small state files: reading them when they may be absent, and writing run records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_or_empty(spark: SparkSession, path: str, schema: str, format: str = "json") -> DataFrame:
    """State of a known schema; an absent path is an empty table, unreadable JSON gives no rows."""
    reader = spark.read.schema(schema).format(format)
    if format == "json":
        reader = reader.options(multiLine=True, mode="DROPMALFORMED")
    try:
        return reader.load(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_run(record: DataFrame, path: str) -> None:
    """Write a run record as JSON lines."""
    record.write.mode("overwrite").json(path)
