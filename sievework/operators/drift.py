"""Schema fingerprints and what changed between two of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .profile import COLUMNS_PER_AGGREGATE, TYPE_SHARE, quoted


def _type(measure: Column) -> Column:
    values = measure["values"]
    return (F.when(values == 0, "empty")
            .when(measure["numbers"] / values > TYPE_SHARE, "numeric")
            .when(measure["dates"] / values > TYPE_SHARE, "date").otherwise("text"))


def fingerprint(df: DataFrame) -> DataFrame:
    """(ordinal, column, inferred_type) of an all-text table, from every value it holds."""
    parts = []
    for start in range(0, len(df.columns), COLUMNS_PER_AGGREGATE):
        batch = list(enumerate(df.columns))[start:start + COLUMNS_PER_AGGREGATE]
        wide = df.agg(*[F.struct(F.count(quoted(c)).alias("values"),
                                 F.count_if(tx.is_plain_number(quoted(c))).alias("numbers"),
                                 F.count_if(tx.is_date_or_time(quoted(c))).alias("dates")).alias(f"c{i}")
                        for i, c in batch])
        parts.append(wide.select(F.inline(F.array(*[
            F.struct(F.lit(i).cast("bigint").alias("ordinal"), F.lit(c).alias("column"),
                     _type(F.col(f"c{i}")).alias("inferred_type")) for i, c in batch]))))
    return reduce(DataFrame.unionByName, parts)


def schema_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(column, change, was, now) for columns added, removed or of another type."""
    was = baseline.select("column", F.col("inferred_type").alias("was"))
    now = current.select("column", F.col("inferred_type").alias("now"))
    change = (F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed")
              .when(F.col("was") != F.col("now"), "type_changed"))
    return (was.join(now, "column", "full_outer").select("column", change.alias("change"), "was", "now")
            .where("change IS NOT NULL"))


def column_set_changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(column, side) with side one of added, removed, shared, by set operations on the names."""
    was, now = baseline.select("column"), current.select("column")
    return (now.exceptAll(was).withColumn("side", F.lit("added"))
            .unionByName(was.exceptAll(now).withColumn("side", F.lit("removed")))
            .unionByName(was.intersect(now).withColumn("side", F.lit("shared"))))
