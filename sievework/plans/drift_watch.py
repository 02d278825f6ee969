"""Drift checks of recurring tables against named baselines.

Baselines are an append-only Parquet log: accepting a schema adds a version, removing one adds an
empty version.  Nothing is overwritten, so a lost executor or a repeated run cannot leave a
baseline half written; the latest version of a name is the one that counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import drift
from ..session import materialize
from ..sources.state import read_or_empty

# --- fixed values: report lines --------------------------------------------------------------------
FIRST_RUN = "No baseline existed for '{name}' — saved the current schema as the baseline ({n} columns: {columns})."
UNCHANGED = "No schema drift for '{name}' — {n} columns, unchanged."
DRIFTED = "Schema drift detected for '{name}':"
ADDED = "  added columns: {columns}"
REMOVED = "  removed columns: {columns}"
TYPE_CHANGED = "  '{column}' type changed: {was} -> {now}"
# -----------------------------------------------------------------------------------------------------

SCHEMA = ("name string, version bigint, ordinal bigint, `column` string, inferred_type string, removed boolean, "
          "origin string")


@dataclass
class DriftReport:
    name: str
    first_run: bool
    columns: list[str]
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    type_changed: list[tuple[str, str, str]] = field(default_factory=list)

    @property
    def drifted(self) -> bool:
        return bool(self.added or self.removed or self.type_changed)


class Baselines:
    """Named schema baselines kept below one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def log(self, besides: str | None = None) -> DataFrame:
        """All versions ever written but those of one origin; empty when there are none yet."""
        log = read_or_empty(self.spark, self.path, SCHEMA, "parquet")
        return log.where(~F.col("origin").eqNullSafe(F.lit(besides))) if besides else log

    def current(self, besides: str | None = None) -> DataFrame:
        """Columns of the latest version of every name that has not been removed."""
        newest = Window.partitionBy("name")
        latest = self.log(besides).withColumn("newest", F.max("version").over(newest))
        return latest.where("version = newest AND NOT removed").drop("newest", "removed")

    def get(self, name: str, besides: str | None = None) -> DataFrame:
        return self.current(besides).where(F.col("name") == name).select("ordinal", "column", "inferred_type")

    def names(self) -> DataFrame:
        """Sorted listing with the number of columns."""
        return self.current().groupBy("name").agg(F.count(F.lit(1)).alias("n_columns")).orderBy("name")

    def _next_version(self, name: str) -> int:
        return (self.log().where(F.col("name") == name).agg(F.max("version")).first()[0] or 0) + 1

    def accept(self, name: str, current: DataFrame, origin: str | None = None) -> None:
        """Make a fingerprint the baseline of a name; ``origin`` says which piece of work did so."""
        rows = current.select(F.lit(name).alias("name"), F.lit(self._next_version(name)).cast("bigint").alias("version"),
                              "ordinal", "column", "inferred_type", F.lit(False).alias("removed"),
                              F.lit(origin).cast("string").alias("origin"))
        rows.coalesce(1).write.mode("append").parquet(self.path)

    def remove(self, name: str) -> bool:
        """Forget a name; false when there is none."""
        if self.get(name).isEmpty():
            return False
        rows = [(name, self._next_version(name), None, None, None, True, None)]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return True

    def check(self, name: str, table: DataFrame, origin: str | None = None) -> DriftReport:
        """Compare a table with its baseline; the first check of a name saves the baseline.

        A check that is run again under the same ``origin`` does not see what its first attempt
        saved, and so reports the same.
        """
        current = materialize(drift.fingerprint(table), "fingerprint")
        columns = [r["column"] for r in current.orderBy("ordinal").collect()]
        baseline = self.get(name, besides=origin)
        if baseline.isEmpty():
            if not origin or self.get(name).isEmpty():
                self.accept(name, current, origin)
            return DriftReport(name, True, columns)
        report = DriftReport(name, False, columns)
        for row in drift.schema_diff(baseline, current).orderBy("column").collect():
            if row["change"] == "type_changed":
                report.type_changed.append((row["column"], row["was"], row["now"]))
            else:
                getattr(report, row["change"]).append(row["column"])
        return report


def render(report: DriftReport) -> list[str]:
    """The report as lines of text."""
    n = len(report.columns)
    if report.first_run:
        return [FIRST_RUN.format(name=report.name, n=n, columns=", ".join(report.columns))]
    if not report.drifted:
        return [UNCHANGED.format(name=report.name, n=n)]
    lines = [DRIFTED.format(name=report.name)]
    lines += [line.format(columns=", ".join(names))
              for line, names in ((ADDED, report.added), (REMOVED, report.removed)) if names]
    return lines + [TYPE_CHANGED.format(column=c, was=was, now=now) for c, was, now in report.type_changed]
