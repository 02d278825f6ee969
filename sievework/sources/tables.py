"""Access to the Parquet tables a query runs over."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import fixtures

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A dirty projection of the given tables (see :mod:`fixtures`)."""
    read: dict[str, DataFrame] = {}

    def named(found: re.Match) -> str:
        if found[2] not in TABLES:
            return found[0]
        read.setdefault(found[2], table(spark, sf_dir, found[2]))
        return f"{found[1]} {{{found[2]}}}"

    # tables are handed over by value: no view of the session is touched
    # and braces of the text itself are doubled, as only those put in here name a table
    text = fixtures.SQL[name].replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"\b(FROM|JOIN)\s+(\w+)\b", named, text), **read)
