"""Schema drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import drift
from ..plans.drift_watch import Baselines
from ..registry import operation
from ..session import work_path
from ..sources.tables import fixture
from . import snippets as q

_V1, _V2 = ["id", "name", "size", "kind"], ["id", "name", "size", "brand"]


def _types(table: str, columns: list[str]) -> str:
    counted = q.per_column(
        table, columns, n=lambda c: f"count({c})",
        numbers=lambda c: f"count(*) FILTER (WHERE regexp_matches({c}, {q.PLAIN_NUMBER}))",
        dates=lambda c: f"count(*) FILTER (WHERE regexp_matches({c}, {q.DATE_OR_TIME}))")
    return (f"SELECT ordinal, column_name, CASE WHEN n = 0 THEN 'empty' WHEN numbers / n > 0.8 THEN 'numeric' "
            f"WHEN dates / n > 0.8 THEN 'date' ELSE 'text' END AS inferred_type FROM ({counted})")


FEEDS = ["feed_v1", "feed_v2"]
BOTH = f"+ f1 AS ({_types('feed_v1', _V1)}), f2 AS ({_types('feed_v2', _V2)}) "
DIFF = """SELECT coalesce(f1.column_name, f2.column_name) AS column_name, CASE WHEN f1.column_name IS NULL THEN 'added'
  WHEN f2.column_name IS NULL THEN 'removed' ELSE 'type_changed' END AS change, f1.inferred_type AS was,
  f2.inferred_type AS now FROM f1 FULL JOIN f2 ON f1.column_name = f2.column_name
WHERE f1.inferred_type IS DISTINCT FROM f2.inferred_type"""


def _prints(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return drift.fingerprint(fixture(spark, sf, "feed_v1")), drift.fingerprint(fixture(spark, sf, "feed_v2"))


@operation("AGG-19", uses=["feed_v1"], sql=_types("feed_v1", _V1))
def schema_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Inferred type of every column of the feed."""
    return drift.fingerprint(fixture(spark, sf, "feed_v1")).withColumnRenamed("column", "column_name")


@operation("AGG-19", uses=["dirty_items"], sql=_types("dirty_items", q.ITEM_COLUMNS))
def items_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Inferred type of every column of the items."""
    return drift.fingerprint(fixture(spark, sf, "dirty_items")).withColumnRenamed("column", "column_name")


@operation("JOIN-5", uses=FEEDS, sql=BOTH + DIFF)
def schema_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Columns added, removed or of another type between two feeds."""
    return drift.schema_diff(*_prints(spark, sf)).withColumnRenamed("column", "column_name")


@operation("SET-2", uses=FEEDS, sql=BOTH + """
SELECT column_name, 'added' AS side FROM (SELECT column_name FROM f2 EXCEPT SELECT column_name FROM f1)
UNION ALL SELECT column_name, 'removed' FROM (SELECT column_name FROM f1 EXCEPT SELECT column_name FROM f2)
UNION ALL SELECT column_name, 'shared' FROM (SELECT column_name FROM f1 INTERSECT SELECT column_name FROM f2)""")
def column_set_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Column names only in one feed or in both."""
    return drift.column_set_changes(*_prints(spark, sf)).withColumnRenamed("column", "column_name")


def _checked(spark: SparkSession, sf: str) -> tuple[Baselines, list]:
    baselines = Baselines(spark, work_path(spark, "baselines"))
    first = baselines.check("parts feed", fixture(spark, sf, "feed_v1"))
    second = baselines.check("parts feed", fixture(spark, sf, "feed_v2"))
    return baselines, [first, second]


@operation("JOB-6", uses=FEEDS, sql=BOTH + f"""
SELECT CAST(1 AS BIGINT) AS check_no, TRUE AS first_run, CAST(NULL AS varchar) AS column_name, 'none' AS change
UNION ALL SELECT 2, FALSE, column_name, change FROM ({DIFF})""")
def drift_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Two checks of a feed: the first saves the baseline, the second reports what changed."""
    _, reports = _checked(spark, sf)
    rows = []
    for i, r in enumerate(reports, 1):
        changes = ([(c, "added") for c in r.added] + [(c, "removed") for c in r.removed]
                   + [(c, "type_changed") for c, _, _ in r.type_changed])
        rows += [(i, r.first_run, *c) for c in changes or [(None, "none")]]
    return spark.createDataFrame(rows, "check_no bigint, first_run boolean, column_name string, change string")


@operation("JOB-6 SRT-5", uses=FEEDS, sql="""
SELECT 'orders feed' AS name, CAST(5 AS BIGINT) AS n_columns UNION ALL SELECT 'parts feed', 4""")
def baseline_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Baselines by name with their number of columns, after accepting, replacing and removing some."""
    baselines, _ = _checked(spark, sf)
    baselines.accept("parts feed", drift.fingerprint(fixture(spark, sf, "feed_v2")))
    baselines.accept("orders feed", drift.fingerprint(fixture(spark, sf, "dirty_orders")))
    baselines.accept("customers feed", drift.fingerprint(fixture(spark, sf, "dirty_customers")))
    baselines.remove("customers feed")
    return baselines.names()


@operation("JOB-6", uses=["feed_v2"], sql=_types("feed_v2", _V2))
def accepted_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """The baseline of a name after a drifted schema was accepted."""
    baselines, _ = _checked(spark, sf)
    baselines.accept("parts feed", drift.fingerprint(fixture(spark, sf, "feed_v2")))
    return baselines.get("parts feed").withColumnRenamed("column", "column_name")
