"""End-to-end jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import score as sc
from ..plans import reports, single_table, two_table
from ..registry import operation
from ..sources.tables import fixture, table
from . import snippets as q

_TWO = ["dirty_customers", "dirty_orders"]


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return fixture(spark, sf, "dirty_customers"), fixture(spark, sf, "dirty_orders")


@operation("JOB-1", uses=_TWO, sql=q.REPAIRED + "SELECT * FROM c_fixed")
def repaired_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers after the two-table repair."""
    customers = fixture(spark, sf, "dirty_customers")
    return two_table.repair_customers(customers).select(*customers.columns)


@operation("JOB-1", uses=_TWO, sql=q.REPAIRED + "SELECT * EXCLUDE (is_orphan) FROM o_all WHERE NOT is_orphan")
def repaired_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders after the two-table repair."""
    return two_table.repair(*_two(spark, sf)).orders


@operation("JOB-1 JOIN-1", uses=_TWO, sql=q.REPAIRED + "SELECT * EXCLUDE (is_orphan) FROM o_all WHERE is_orphan")
def quarantined_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders set aside by the two-table repair."""
    return two_table.repair(*_two(spark, sf)).quarantine


_DIFFERS = "count(*) FILTER (WHERE {0} IS DISTINCT FROM {1})"


@operation("JOB-1", uses=_TWO, sql=q.REPAIRED + f"""
SELECT CAST(1 AS BIGINT) AS step, 'customer_id' AS column_name, 'normalised customer keys' AS action,
  {_DIFFERS.format('customer_id', q.norm_key('customer_id'))} AS n_changed FROM dirty_customers
UNION ALL SELECT 2, '', 'dropped duplicate customers', (SELECT count(*) FROM dirty_customers) - (SELECT count(*) FROM c_in)
UNION ALL SELECT 2, '', 'dropped duplicate orders', (SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM o_in)
UNION ALL SELECT 3, 'signup_date', 'rewrote dates to ISO', {_DIFFERS.format('signup_date', q.iso_rewrite('signup_date'))} FROM c_in
UNION ALL SELECT 4, 'state', 'canonicalised categories', {_DIFFERS.format('state', 'upper(trim(state))')} FROM c_in
UNION ALL SELECT 6, 'name', 'filled missing names', count(*) FILTER (WHERE {q.is_missing('name')}) FROM c_in
UNION ALL SELECT 3, 'order_date', 'rewrote dates to ISO', {_DIFFERS.format('order_date', q.iso_rewrite('order_date'))} FROM o_in
UNION ALL SELECT 4, 'status', 'lower-cased categories', {_DIFFERS.format('status', 'lower(trim(status))')} FROM o_in
UNION ALL SELECT 5, 'amount', 'set unreadable amounts to zero', count(*) FILTER (WHERE ({q.number('amount')}) IS NULL) FROM o_in
UNION ALL SELECT 7, 'customer_id', 'quarantined orphaned orders', count(*) FILTER (WHERE is_orphan) FROM o_all""")
def repair_changelog(spark: SparkSession, sf: str) -> DataFrame:
    """What the two-table repair changed, with counts."""
    return two_table.repair(*_two(spark, sf)).changelog().withColumnRenamed("column", "column_name")


def _metric(table: str, column: str, metric: str, value: str, source: str) -> str:
    return f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{metric}' AS metric, {value} AS value FROM {source}"


def _inspect_sql() -> str:
    parts = []
    for name, columns, date, category in (("customers", q.CUSTOMER_COLUMNS, "signup_date", "state"),
                                          ("orders", q.ORDER_COLUMNS, "order_date", "status")):
        source = f"dirty_{name}"
        parts.append(_metric(name, "", "rows", "count(*)", source))
        parts.append(_metric(name, "", "duplicate_rows",
                             f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source}))", source))
        parts += [_metric(name, c, "missing", f"count(*) FILTER (WHERE {q.is_missing(c)})", source) for c in columns]
        for style, pattern in (("ISO (YYYY-MM-DD)", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
                               ("US (MM/DD/YYYY)", "^[0-9]{2}/[0-9]{2}/[0-9]{4}$"),
                               ("Text (DD Mon YYYY)", "^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$")):
            parts.append(_metric(name, date, f"date style {style}",
                                 f"count(*) FILTER (WHERE regexp_matches(trim({date}), '{pattern}'))", source))
        parts.append(_metric(name, category, "variant groups", "count(*)", f"""
          (SELECT lower(trim({category})) FROM {source} WHERE {category} IS NOT NULL GROUP BY 1
           HAVING count(DISTINCT {category}) > 1)"""))
    parts.append(_metric("orders", "amount", "messy numbers",
                         "count(*) FILTER (WHERE trim(amount) <> amount OR regexp_matches(amount, '[^0-9.\\-]'))",
                         "dirty_orders"))
    parts.append(_metric("join", "customer_id", "orders_total", "count(*)", "dirty_orders"))
    parts.append(_metric("join", "customer_id", "orphaned_orders", f"""count(*) FILTER (WHERE customer_id IS NOT NULL
      AND {q.norm_key('customer_id')} NOT IN (SELECT {q.norm_key('customer_id')} FROM dirty_customers))""", "dirty_orders"))
    parts.append(_metric("customers", "customer_id", "noisy keys", """count(*) FILTER
      (WHERE trim(customer_id) <> customer_id OR upper(customer_id) <> customer_id)""", "dirty_customers"))
    return "\nUNION ALL ".join(parts)


@operation("JOB-2 AGG-3", uses=_TWO, sql=_inspect_sql())
def inspection(spark: SparkSession, sf: str) -> DataFrame:
    """Defects of both tables and of the join between them."""
    return (two_table.inspect(*_two(spark, sf)).withColumnRenamed("column", "column_name")
            .withColumnRenamed("table", "table_name"))


_BEFORE_AFTER = ("o_fixed AS (SELECT order_id, customer_id, CAST(amount AS varchar) AS amount, order_date, status "
                 "FROM o_all WHERE NOT is_orphan)")


@operation("JOB-3", uses=_TWO, sql=q.REPAIRED + f", {_BEFORE_AFTER} "
           f"SELECT 'before' AS phase, * FROM ({q.scorecard_wide(q.scorecard('dirty_customers', 'dirty_orders'))}) "
           f"UNION ALL SELECT 'after', * FROM ({q.scorecard_wide(q.scorecard('c_fixed', 'o_fixed'))})")
def before_after_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Scorecards before and after the two-table repair."""
    columns = [*sc.DIMENSIONS, "overall"]
    return two_table.before_after(*_two(spark, sf)).select("phase", *[F.round(c, 6).alias(c) for c in columns])


@operation("JOB-4", uses=["dirty_items"], sql=q.repaired_items("dirty_items") + "SELECT * FROM clean_items")
def repaired_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items after the one-table repair."""
    return single_table.repair(single_table.stage(fixture(spark, sf, "dirty_items"))).table


def _trimmed(table: str) -> str:
    return " + ".join(f"count(*) FILTER (WHERE {c} <> trim({c}))" for c in q.ITEM_COLUMNS) + f" FROM {table}"


def _imputed(table: str) -> str:
    holes = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in ("price", "quantity", "flag", "discount"))
    return f"{holes} FROM {table}"


@operation("JOB-4", uses=["dirty_items"], sql=q.repaired_items("dirty_items") + f"""
SELECT * FROM (
SELECT CAST(1 AS BIGINT) AS step, '' AS column_name, 'trimmed' AS action, {_trimmed('dirty_items')}
UNION ALL SELECT 2, '', 'deduplicated', (SELECT count(*) FROM dirty_items) - (SELECT count(*) FROM unique_items)
UNION ALL SELECT 3, 'price', 'currency', count(*) FROM unique_items
UNION ALL SELECT 3, 'discount', 'percent', count(*) FROM unique_items
UNION ALL SELECT 3, 'ship_date', 'date', count(*) FILTER (WHERE ship_date <> {q.iso_any('ship_date')}) FROM unique_items
UNION ALL SELECT 4, 'flag', 'canonicalised', (SELECT count(*) FROM flag_counts) - (SELECT count(*) FROM flag_best)
UNION ALL SELECT 5, '', 'imputed', {_imputed('coerced')}) t(step, column_name, action, n_changed) WHERE n_changed > 0""")
def items_changelog(spark: SparkSession, sf: str) -> DataFrame:
    """What the one-table repair changed, with counts."""
    steps = single_table.repair(single_table.stage(fixture(spark, sf, "dirty_items"))).steps
    return spark.createDataFrame(steps, "step bigint, column_name string, action string, n_changed bigint")


_SCORES = ["completeness", "uniqueness", "validity", "consistency", "overall"]


def _clean_score(table: str) -> str:
    """Score of a repaired table: numbers are typed, dates ISO, spellings unified, so two parts are full."""
    missing = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL OR CAST({c} AS varchar) = '')" for c in q.ITEM_COLUMNS)
    complete = f"100.0 * (1 - (SELECT {missing} FROM {table}) / ((SELECT count(*) FROM {table}) * 6.0))"
    unique = f"100.0 * (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) / (SELECT count(*) FROM {table})"
    return (f"round({complete}, 6), round({unique}, 6), 100.0, 100.0, round(({complete} + {unique} + 200.0) / 4, 6)")


def _raw_score(table: str) -> str:
    missing = " + ".join(f"count(*) FILTER (WHERE {q.is_missing(c)})" for c in q.ITEM_COLUMNS)
    complete = f"100.0 * (1 - (SELECT {missing} FROM {table}) / ((SELECT count(*) FROM {table}) * 6.0))"
    unique = f"100.0 * (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) / (SELECT count(*) FROM {table})"
    valid = (f"100.0 * (SELECT count(*) FILTER (WHERE regexp_matches(ship_date, {q.ISO})) FROM {table}) / "
             f"(SELECT count(price) + count(discount) + count(ship_date) FROM {table})")
    return (f"round({complete}, 6), round({unique}, 6), round({valid}, 6), 0.0, "
            f"round(({complete} + {unique} + {valid} + 0.0) / 4, 6)")


def _score_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    fields = ", ".join(f"{c} double" for c in _SCORES)
    return spark.createDataFrame([(phase, *[float(round(s[c], 6)) for c in _SCORES]) for phase, s in rows],
                                 f"phase string, {fields}")


def _score_sql(*phases: tuple[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{phase}', {scores}" for phase, scores in phases)
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _SCORES)
    return f"SELECT phase, {casts} FROM ({rows}) t(phase, {', '.join(_SCORES)})"


@operation("JOB-4", uses=["dirty_items"], sql=q.repaired_items("dirty_items")
           + _score_sql(("before", _raw_score("dirty_items")), ("after", _clean_score("clean_items"))))
def items_before_after(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the items before and after the one-table repair."""
    report = single_table.run_once(fixture(spark, sf, "dirty_items"))
    return _score_rows(spark, [("before", report.before), ("after", report.after)])


_KEPT = ", kept AS (SELECT DISTINCT * FROM clean_items WHERE flag <> 'UNKNOWN')\n"


@operation("JOB-5", uses=["sparse_items"], sql=q.repaired_items("sparse_items") + _KEPT + "SELECT * FROM kept")
def trusted_items(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse items after the trust-routed loop, rows with the placeholder set aside."""
    return single_table.run_trusted(fixture(spark, sf, "sparse_items"), mode="reference").table


_HOLES = " + ".join(f"count(*) FILTER (WHERE {q.is_missing_word(c)})" for c in q.ITEM_COLUMNS)


@operation("JOB-5 WIN-9", uses=["sparse_items"], sql=q.repaired_items("sparse_items") + _KEPT + f"""
, s AS ({_score_sql(("pass 1", _clean_score("clean_items")), ("pass 2", _clean_score("kept")))})
SELECT CAST(1 AS BIGINT) AS attempt, 'conservative' AS strategy, (SELECT overall FROM s WHERE phase = 'pass 1') AS score,
  CAST(round((SELECT {_HOLES} FROM sparse_items) / ((SELECT count(*) FROM sparse_items) * 6.0), 6) AS DOUBLE)
    AS imputed_share
UNION ALL SELECT 2, 'aggressive', (SELECT overall FROM s WHERE phase = 'pass 2'), 0.0""")
def trust_history(spark: SparkSession, sf: str) -> DataFrame:
    """Score and invented share of each pass of the trust-routed loop."""
    report = single_table.run_trusted(fixture(spark, sf, "sparse_items"), mode="reference")
    rows = [(h["attempt"], h["strategy"], round(h["score"], 6), round(h["imputed_share"], 6)) for h in report.history]
    return spark.createDataFrame(rows, "attempt bigint, strategy string, score double, imputed_share double")


@operation("JOB-5 SET-4", uses=["sparse_items"], sql=q.repaired_items("sparse_items")
           + "SELECT * FROM clean_items WHERE flag = 'UNKNOWN'")
def quarantined_items(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse items set aside by the trust-routed loop."""
    return single_table.run_trusted(fixture(spark, sf, "sparse_items"), mode="reference").quarantine


@operation("JOB-5 SET-4", uses=["sparse_items"], sql=q.repaired_items("sparse_items") + f"""
SELECT item_id, price, discount, quantity_text AS quantity, ship_date, flag FROM coerced
WHERE price IS NULL OR discount IS NULL OR quantity IS NULL OR flag IS NULL""")
def honest_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse items with any missing cell, as the default mode of the loop sets them aside."""
    return single_table.run_trusted(fixture(spark, sf, "sparse_items")).quarantine


@operation("JOB-7", uses=["dirty_customers"], sql="SELECT * FROM dirty_customers")
def injected_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Seven defect classes put into the clean customers."""
    return _injected(spark, sf)[0]


@operation("JOB-7", uses=["dirty_orders"], sql="SELECT * FROM dirty_orders")
def injected_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Seven defect classes put into the clean orders."""
    return _injected(spark, sf)[1]


def _injected(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    customers = table(spark, sf, "customer").select(
        k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("state"),
        F.make_date((2020 + k % 5).cast("int"), (k % 12 + 1).cast("int"), (k % 28 + 1).cast("int")).alias("signup_date"))
    status = F.when(F.col("o_orderstatus") == "F", "shipped").when(F.col("o_orderstatus") == "O", "pending")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.col("o_orderdate").cast("date").alias("order_date"), status.otherwise("cancelled").alias("status"))
    return two_table.inject_defects(customers, orders)


@operation("JOB-8", uses=_TWO, sql=q.REPAIRED + f", {_BEFORE_AFTER}, "
           f"b AS ({q.scorecard_wide(q.scorecard('dirty_customers', 'dirty_orders'))}), "
           f"a AS ({q.scorecard_wide(q.scorecard('c_fixed', 'o_fixed'))})" + " UNION ALL ".join(
               f" SELECT {i} AS position, printf('%-16s%8.1f%8.1f', '{d}', b.{d}, a.{d}) AS line FROM a, b"
               for i, d in enumerate([*sc.DIMENSIONS, "overall"], 1)))
def scorecard_text(spark: SparkSession, sf: str) -> DataFrame:
    """Scorecard of the two tables as text lines."""
    return reports.scorecard_lines(two_table.before_after(*_two(spark, sf)), [*sc.DIMENSIONS, "overall"])


@operation("JOB-8")
def loop_text(spark: SparkSession, sf: str) -> DataFrame:
    """Report of the trust-routed loop as text lines."""
    report = single_table.run_trusted(fixture(spark, sf, "sparse_items"))
    return spark.createDataFrame(list(enumerate(reports.loop_lines("sparse_items", report), 1)),
                                 "position int, line string")


@operation("JOB-1 SNK-1", uses=_TWO, sql=q.REPAIRED + """
SELECT (SELECT count(*) FROM c_fixed) AS customers_rows, (SELECT count(*) FROM o_all WHERE NOT is_orphan) AS orders_rows,
  (SELECT count(*) FROM o_all WHERE is_orphan) AS quarantined_rows""")
def written_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts of the repaired tables after writing them as CSV and reading them back."""
    from ..session import work_path
    from ..sources import csv

    fixed, folder = two_table.repair(*_two(spark, sf)), work_path(spark, "repair")
    paths = [csv.write_table(fixed.customers, f"{folder}/customers_clean"),
             csv.write_table(fixed.orders, f"{folder}/orders_clean"),
             csv.write_if_any(fixed.quarantine, f"{folder}/orders_quarantine")]
    counts = [csv.read_text_table(spark, p).count() if p else 0 for p in paths]
    return spark.createDataFrame([tuple(counts)], "customers_rows bigint, orders_rows bigint, quarantined_rows bigint")
