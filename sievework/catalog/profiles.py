"""Profiles and scorecards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import profile as pf
from ..operators import score as sc
from ..plans.single_table import stage
from ..registry import operation
from ..sources.tables import fixture
from . import snippets as q


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return fixture(spark, sf, "dirty_customers"), fixture(spark, sf, "dirty_orders")


@operation("AGG-1", uses=["dirty_customers"], sql=q.per_column(
    "dirty_customers", q.CUSTOMER_COLUMNS, n_missing=lambda c: f"count(*) FILTER (WHERE {q.is_missing(c)})"))
def missing_per_column(spark: SparkSession, sf: str) -> DataFrame:
    """Missing cells per column."""
    return pf.missing_counts(fixture(spark, sf, "dirty_customers")).withColumnRenamed("column", "column_name")


@operation("AGG-2", uses=["dirty_orders"], sql="""
SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS n_distinct,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS n_duplicates FROM dirty_orders""")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, distinct rows and exact duplicates of the orders."""
    return pf.duplicate_counts(fixture(spark, sf, "dirty_orders"))


_STYLE = ("CASE WHEN regexp_matches(trim({0}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'ISO (YYYY-MM-DD)' "
          "WHEN regexp_matches(trim({0}), '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') THEN 'US (MM/DD/YYYY)' "
          "WHEN regexp_matches(trim({0}), '^[0-9]{{1,2}} [A-Za-z]{{3}} [0-9]{{4}}$') THEN 'Text (DD Mon YYYY)' "
          "ELSE 'Unknown' END")


@operation("AGG-4", uses=["dirty_orders"], sql=f"""
SELECT 'order_date' AS column_name, {_STYLE.format('order_date')} AS style, count(*) AS n
FROM dirty_orders WHERE order_date IS NOT NULL GROUP BY 2""")
def date_styles(spark: SparkSession, sf: str) -> DataFrame:
    """Number of dates in each spelling."""
    return pf.date_style_census(fixture(spark, sf, "dirty_orders")).withColumnRenamed("column", "column_name")


@operation("AGG-5", uses=["dirty_customers"], sql="""
SELECT 'state' AS column_name, norm, state AS value, n, n_spellings FROM (
  SELECT lower(trim(state)) AS norm, state, count(*) AS n,
    count(*) OVER (PARTITION BY lower(trim(state))) AS n_spellings
  FROM dirty_customers WHERE state IS NOT NULL GROUP BY 1, 2) WHERE n_spellings > 1""")
def casing_variants(spark: SparkSession, sf: str) -> DataFrame:
    """States that differ only in case or blanks."""
    return pf.casing_variants(fixture(spark, sf, "dirty_customers"), ["state"]).withColumnRenamed("column", "column_name")


_KIND_COUNTS = q.per_column(
    "dirty_items", q.ITEM_COLUMNS, n=lambda c: f"count({c})",
    cur=lambda c: f"count(*) FILTER (WHERE regexp_matches({c}, {q.CURRENCY}))",
    pct=lambda c: f"count(*) FILTER (WHERE regexp_matches({c}, {q.PERCENT}))",
    com=lambda c: f"count(*) FILTER (WHERE regexp_matches({c}, {q.COMMA_NUMBER}))",
    iso=lambda c: f"count(*) FILTER (WHERE regexp_matches({c}, {q.ISO}))",
    parsed=lambda c: f"count(try_strptime({c}, ['%Y-%m-%d', '%m/%d/%Y', '%d %b %Y']))",
    example=lambda c: f"min({c})")


@operation("AGG-7", uses=["dirty_items"], sql=f"""+
k AS ({_KIND_COUNTS})
SELECT * FROM (SELECT ordinal, column_name, CASE WHEN cur / n > 0.5 THEN 'currency' WHEN pct / n > 0.5 THEN 'percent'
  WHEN com / n > 0.5 THEN 'comma_number'
  WHEN column_name LIKE '%date%' AND iso / n < 0.99 AND parsed / n > 0.7 THEN 'date' END AS kind, example FROM k)
WHERE kind IS NOT NULL""")
def column_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that hide numbers or dates in text."""
    return pf.column_kinds(fixture(spark, sf, "dirty_items")).withColumnRenamed("column", "column_name")


@operation("AGG-8", uses=["dirty_items"], sql="""+
counts AS (SELECT lower(trim(flag)) AS norm, flag AS value, count(*) AS n FROM dirty_items
           WHERE flag IS NOT NULL GROUP BY 1, 2),
best AS (SELECT *, first_value(value) OVER (PARTITION BY norm ORDER BY n DESC, value) AS canonical FROM counts)
SELECT 'flag' AS column_name, value, canonical, n FROM best WHERE value <> canonical""")
def spelling_map(spark: SparkSession, sf: str) -> DataFrame:
    """Variant to canonical spelling for every low-cardinality column."""
    items = fixture(spark, sf, "dirty_items")
    gate = pf.aggregate_columns(items, items.columns, pf.spelling_measures)
    return pf.spelling_map(items, pf.gated(gate)).withColumnRenamed("column", "column_name")


@operation("AGG-9", uses=["dirty_items"], sql=f"""+
m AS ({q.per_column('dirty_items', q.ITEM_COLUMNS, n=lambda c: f"count(*) FILTER (WHERE {q.is_missing(c)})")}),
k AS ({_KIND_COUNTS}),
v AS (SELECT count(*) AS n FROM (SELECT flag, lower(trim(flag)) AS norm, count(*) AS n FROM dirty_items
      WHERE flag IS NOT NULL GROUP BY 1, 2)),
g AS (SELECT count(DISTINCT lower(trim(flag))) AS n FROM dirty_items)
SELECT 'rows' AS metric, NULL AS column_name, CAST(count(*) AS varchar) AS value FROM dirty_items
UNION ALL SELECT 'columns', NULL, '6'
UNION ALL SELECT 'duplicate_rows', NULL, CAST((SELECT count(*) FROM dirty_items)
  - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_items)) AS varchar)
UNION ALL SELECT 'missing_cells', NULL, CAST(sum(n) AS varchar) FROM m
UNION ALL SELECT 'missing', column_name, CAST(n AS varchar) FROM m
UNION ALL SELECT 'kind', column_name, CASE WHEN cur / n > 0.5 THEN 'currency' WHEN pct / n > 0.5 THEN 'percent'
  WHEN com / n > 0.5 THEN 'comma_number' ELSE 'date' END FROM k
  WHERE cur / n > 0.5 OR pct / n > 0.5 OR com / n > 0.5
    OR (column_name LIKE '%date%' AND iso / n < 0.99 AND parsed / n > 0.7)
UNION ALL SELECT 'spelling_variants', 'flag', CAST(v.n - g.n AS varchar) FROM v, g WHERE v.n > g.n""")
def table_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Profile of the items as (metric, column, value) rows."""
    profile = pf.profile_table(stage(fixture(spark, sf, "dirty_items")))
    return spark.createDataFrame(pf.profile_metrics(profile), "metric string, column_name string, value string")


_MISSING_ROWS = q.per_column("dirty_items", q.ITEM_COLUMNS, n=lambda c: f"count(*) FILTER (WHERE {q.is_missing(c)})")


def _issues(kinds: str, spellings: bool, copies: str, limit: int) -> str:
    """Numbered sentences: kinds in column order, spelling variants, copies, worst missing columns."""
    variants = """
UNION ALL SELECT 2, 0, '''flag'' has inconsistent categorical variants (' ||
  string_agg('''' || value || '''→''' || canonical || '''', ', ' ORDER BY value) || ')'
  FROM (SELECT value, canonical FROM best WHERE value <> canonical ORDER BY value LIMIT 2) HAVING count(*) > 0"""
    return f"""+
k AS ({_KIND_COUNTS}), m AS ({_MISSING_ROWS}),
counts AS (SELECT lower(trim(flag)) AS norm, flag AS value, count(*) AS n FROM dirty_items
           WHERE flag IS NOT NULL GROUP BY 1, 2),
best AS (SELECT *, first_value(value) OVER (PARTITION BY norm ORDER BY n DESC, value) AS canonical FROM counts),
d AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_items)) AS n FROM dirty_items),
s(part, place, issue) AS (
SELECT 1, ordinal, '''' || column_name || ''' stores ' || kind || ' as text (e.g. "' || example || '") — ' FROM
  (SELECT *, {kinds} AS kind FROM k) WHERE kind IS NOT NULL{variants if spellings else ''}
UNION ALL SELECT 3, 0, n || '{copies}' FROM d WHERE n > 0
UNION ALL SELECT 4, row_number() OVER (ORDER BY n DESC, ordinal), n || ' missing values in ''' || column_name || ''''
  FROM (SELECT * FROM m WHERE n > 0 ORDER BY n DESC, ordinal LIMIT 5))
SELECT CAST(row_number() OVER (ORDER BY part, place) AS INTEGER) AS position,
  CASE WHEN part = 1 THEN issue || '{'needs coercion' if spellings else 'needs numeric coercion'}' ELSE issue END AS issue
FROM s ORDER BY 1 LIMIT {limit}"""


_DOLLARS = f"(SELECT count(*) FILTER (WHERE regexp_matches(price, {q.DOLLAR_ONLY})) / count(price) FROM dirty_items)"
_PERCENTS = f"(SELECT count(*) FILTER (WHERE regexp_matches(discount, {q.PERCENT_TIGHT})) / count(discount) FROM dirty_items)"


@operation("AGG-9", uses=["dirty_items"], sql=_issues("""CASE WHEN cur / n > 0.5 THEN 'currency'
  WHEN pct / n > 0.5 THEN 'percentages' WHEN com / n > 0.5 THEN 'comma-formatted numbers'
  WHEN column_name LIKE '%date%' AND iso / n < 0.99 AND parsed / n > 0.7 THEN 'non-ISO dates' END""",
    True, " exact duplicate rows", 100))
def table_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of the items as sentences, worst missing columns last."""
    profile = pf.profile_table(stage(fixture(spark, sf, "dirty_items")))
    return spark.createDataFrame(list(enumerate(profile.issues, 1)), "position int, issue string")


def _score(missing: str, rows: str, distinct: str, columns: int, valid: str, checked: str, consistency: float) -> str:
    parts = {"completeness": f"100.0 * (1 - ({missing}) / (({rows}) * {columns}.0))",
             "uniqueness": f"100.0 * ({distinct}) / ({rows})",
             "validity": f"100.0 * ({valid}) / ({checked})", "consistency": f"{consistency}"}
    shown = ", ".join(f"CAST(round({v}, 6) AS DOUBLE) AS {k}" for k, v in parts.items())
    mean = " + ".join(f"({v})" for v in parts.values())
    return f"{shown}, CAST(round(({mean}) / 4, 6) AS DOUBLE) AS overall"


_MISSING = " + ".join(f"count(*) FILTER (WHERE {q.is_missing(c)})" for c in q.ITEM_COLUMNS)


@operation("AGG-10", uses=["dirty_items"], sql="SELECT " + _score(
    f"SELECT {_MISSING} FROM dirty_items", "SELECT count(*) FROM dirty_items",
    "SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_items)", 6,
    f"SELECT count(*) FILTER (WHERE regexp_matches(ship_date, {q.ISO})) FROM dirty_items",
    "SELECT count(price) + count(discount) + count(ship_date) FROM dirty_items", 0.0))
def table_score(spark: SparkSession, sf: str) -> DataFrame:
    """Completeness, uniqueness, validity and consistency of the items as they are."""
    items = stage(fixture(spark, sf, "dirty_items"))
    profile = pf.profile_table(items)
    scored = sc.generic_score(items, profile.kinds, bool(profile.spellings))
    return scored.select(*[F.round(c, 6).alias(c) for c in
                           ("completeness", "uniqueness", "validity", "consistency", "overall")])


@operation("AGG-11", uses=["dirty_items"], sql=f"""+
t AS (SELECT count(*) AS n, {_MISSING} AS m FROM dirty_items),
d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM dirty_items))
SELECT t.n AS n_rows, t.n - d.n AS duplicate_rows, t.m AS missing_cells,
  round(100.0 * (1 - t.m / (t.n * 6.0)), 6) AS completeness, round(100.0 * (1 - (t.n - d.n) / t.n), 6) AS uniqueness,
  round((100.0 * (1 - t.m / (t.n * 6.0)) + 100.0 * (1 - (t.n - d.n) / t.n)) / 2, 6) AS overall FROM t, d""")
def quick_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Short profile of the items."""
    p = pf.quick_profile(stage(fixture(spark, sf, "dirty_items")))
    row = (p["rows"], p["duplicate_rows"], p["missing_cells"], *[round(p[k], 6) for k in
                                                               ("completeness", "uniqueness", "overall")])
    return spark.createDataFrame([row], "n_rows bigint, duplicate_rows bigint, missing_cells bigint, "
                                        "completeness double, uniqueness double, overall double")


@operation("AGG-11 SRT-2", uses=["dirty_items"], sql=_issues(f"""CASE WHEN column_name = 'price' AND {_DOLLARS} > 0.5
  THEN 'currency' WHEN column_name = 'discount' AND {_PERCENTS} > 0.5 THEN 'percentages' END""",
    False, " duplicate rows", 8))
def quick_profile_issues(spark: SparkSession, sf: str) -> DataFrame:
    """At most eight issues of the items."""
    issues = pf.quick_profile(stage(fixture(spark, sf, "dirty_items")))["issues"]
    return spark.createDataFrame(list(enumerate(issues, 1)), "position int, issue string")


@operation("SRT-1", uses=["dirty_items"], sql=f"""
SELECT * FROM ({q.per_column('dirty_items', q.ITEM_COLUMNS,
                             n_missing=lambda c: f"count(*) FILTER (WHERE {q.is_missing(c)})")})
WHERE n_missing > 0 ORDER BY n_missing DESC, ordinal LIMIT 5""")
def top_missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The five columns with most missing cells."""
    return pf.top_missing(fixture(spark, sf, "dirty_items")).withColumnRenamed("column", "column_name")


_TWO = ["dirty_customers", "dirty_orders"]
_PARTS = q.scorecard("dirty_customers", "dirty_orders")


def _dimension(name: str) -> str:
    return (f"SELECT CAST(sum(good) AS BIGINT) AS good, CAST(sum(total) AS BIGINT) AS total FROM ({_PARTS}) "
            f"WHERE dimension = '{name}'")


def _one(df: DataFrame, *more: DataFrame) -> DataFrame:
    for other in more:
        df = df.unionByName(other)
    return df.agg(F.sum("good").alias("good"), F.sum("total").alias("total"))


@operation("AGG-12 SET-3", uses=_TWO, sql=_dimension("completeness"))
def score_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Filled required cells of both tables."""
    customers, orders = _two(spark, sf)
    return _one(sc.measured(customers, sc.completeness(customers, sc.REQUIRED_CUSTOMER)),
                sc.measured(orders, sc.completeness(orders, sc.REQUIRED_ORDER)))


@operation("AGG-13 SET-3", uses=_TWO, sql=_dimension("uniqueness"))
def score_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct rows of both tables."""
    customers, orders = _two(spark, sf)
    return _one(sc.uniqueness(customers), sc.uniqueness(orders))


@operation("AGG-14", uses=_TWO, sql=_dimension("validity"))
def score_validity(spark: SparkSession, sf: str) -> DataFrame:
    """ISO dates and clean amounts of the orders."""
    return _one(sc.measured(fixture(spark, sf, "dirty_orders"), sc.validity()))


@operation("AGG-15", uses=_TWO, sql=_dimension("consistency"))
def score_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Category groups with one spelling, over states and statuses."""
    customers, orders = _two(spark, sf)
    return _one(sc.consistency(customers, "state"), sc.consistency(orders, "status"))


@operation("AGG-16 SET-3", uses=_TWO, sql=_dimension("key_hygiene"))
def score_key_hygiene(spark: SparkSession, sf: str) -> DataFrame:
    """Clean keys of both tables."""
    customers, orders = _two(spark, sf)
    return _one(sc.measured(customers, sc.key_hygiene()), sc.measured(orders, sc.key_hygiene()))


@operation("AGG-17", uses=_TWO, sql=q.scorecard_wide(_PARTS))
def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Six-dimension scorecard of the two tables."""
    columns = [*sc.DIMENSIONS, "overall"]
    return sc.scorecard(*_two(spark, sf)).select(*[F.round(c, 6).alias(c) for c in columns])


_WIDE = " + ".join(f"count(*) FILTER (WHERE {q.is_missing_word(c)})" for c in q.ITEM_COLUMNS)


@operation("AGG-18", uses=["sparse_items"], sql=f"""
SELECT {_WIDE} AS n_missing, count(*) * 6 AS n_cells, round(({_WIDE}) / (count(*) * 6.0), 6) AS share FROM sparse_items""")
def missing_share(spark: SparkSession, sf: str) -> DataFrame:
    """Share of cells a repair would have to invent."""
    return sc.missing_share(fixture(spark, sf, "sparse_items")).withColumn("share", F.round("share", 6))


@operation("AGG-2 AGG-8", uses=["dirty_customers"], sql="""
SELECT CAST(copies AS BIGINT) AS copies, count(*) AS n_rows FROM
  (SELECT count(*) AS copies FROM dirty_customers GROUP BY customer_id, name, state, signup_date, email) GROUP BY 1""")
def copies_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """How many distinct customer rows occur how often."""
    return (pf.multiplicities(fixture(spark, sf, "dirty_customers")).groupBy(F.col("__copies").alias("copies"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


@operation("PRD-6", uses=["dirty_customers"], sql="""
SELECT count(*) FILTER (WHERE trim(customer_id) <> customer_id OR upper(customer_id) <> customer_id) AS n_noisy,
  count(customer_id) AS n_keys FROM dirty_customers""")
def key_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Noisy customer keys among all keys."""
    c = F.col("customer_id")
    return fixture(spark, sf, "dirty_customers").agg(F.count_if(tx.is_noisy_key(c)).alias("n_noisy"),
                                                     F.count(c).alias("n_keys"))
