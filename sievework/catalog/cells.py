"""Operations on single cells, on rows, and between two tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import profile as pf
from ..operators import repair as rp
from ..operators import score as sc
from ..plans import single_table, two_table
from ..registry import operation, run
from ..sources.tables import fixture
from . import snippets as q

SEGMENT_CODES = {"building": "BLD", "machinery": "MCH", "household": "HSH"}


@operation("PRJ-1", uses=["dirty_items"], sql=q.per_column(
    "dirty_items", q.ITEM_COLUMNS, n_changed=lambda c: f"count(*) FILTER (WHERE {c} <> trim({c}))"))
def trimmed_cell_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Cells per column that change when outer white space is removed."""
    items = fixture(spark, sf, "dirty_items")
    return pf.long_counts(items, items.columns, lambda c: ~pf.quoted(c).eqNullSafe(tx.strip(pf.quoted(c))),
                          "n_changed").withColumnRenamed(
        "column", "column_name")


@operation("PRJ-1", uses=["dirty_items"], sql="SELECT " + ", ".join(f"trim({c}) AS {c}" for c in q.ITEM_COLUMNS)
           + " FROM dirty_items")
def trimmed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items with every text cell trimmed."""
    return rp.trim_text(fixture(spark, sf, "dirty_items"))


@operation("PRJ-2", uses=["dirty_customers"],
           sql=f"SELECT customer_id, {q.norm_key('customer_id')} AS norm_id FROM dirty_customers")
def normalised_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Customer keys without outer blanks and in upper case."""
    return fixture(spark, sf, "dirty_customers").select("customer_id", tx.norm_key(F.col("customer_id")).alias("norm_id"))


@operation("PRJ-3", uses=["dirty_orders"], sql=f"SELECT order_id, {q.number('amount')} AS amount FROM dirty_orders")
def numbers_from_text(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts read out of currency texts; unreadable ones are null."""
    return fixture(spark, sf, "dirty_orders").select("order_id", tx.to_number(F.col("amount")).alias("amount"))


@operation("PRJ-4", uses=["dirty_items"], sql=f"SELECT item_id, {q.iso_any('ship_date')} AS ship_date FROM dirty_items")
def iso_dates_any_format(spark: SparkSession, sf: str) -> DataFrame:
    """Dates of any accepted format as ISO text."""
    return fixture(spark, sf, "dirty_items").select("item_id", tx.to_iso(F.col("ship_date")).alias("ship_date"))


@operation("PRJ-5", uses=["dirty_orders"],
           sql=f"SELECT order_id, order_date, {q.iso_rewrite('order_date')} AS iso_date FROM dirty_orders")
def iso_dates_three_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Three date spellings rewritten to ISO text."""
    return fixture(spark, sf, "dirty_orders").select("order_id", "order_date",
                                                     tx.rewrite_date(F.col("order_date")).alias("iso_date"))


@operation("PRJ-6", uses=["dirty_customers"], sql="""
SELECT customer_id, CASE lower(trim(state)) WHEN 'building' THEN 'BLD' WHEN 'machinery' THEN 'MCH'
  WHEN 'household' THEN 'HSH' ELSE upper(trim(state)) END AS state FROM dirty_customers""")
def canonical_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Categories through a dictionary, others in upper case."""
    return fixture(spark, sf, "dirty_customers").select(
        "customer_id", rp.canonical_category(F.col("state"), SEGMENT_CODES).alias("state"))


@operation("PRJ-7", uses=["dirty_orders"], sql="SELECT order_id, lower(trim(status)) AS status FROM dirty_orders")
def lowercase_status(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses in lower case without outer blanks."""
    return fixture(spark, sf, "dirty_orders").select("order_id", tx.spelling(F.col("status")).alias("status"))


@operation("PRJ-8", uses=["dirty_orders"], sql=f"""
SELECT order_id, coalesce({q.number('amount')}, 0.0) AS amount, ({q.number('amount')}) IS NULL AS was_filled
FROM dirty_orders""")
def filled_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts as numbers, zero where none can be read."""
    return fixture(spark, sf, "dirty_orders").select(
        "order_id", rp.filled_amount(F.col("amount")).alias("amount"),
        tx.to_number(F.col("amount")).isNull().alias("was_filled"))


@operation("PRJ-9", uses=["dirty_customers"], sql=f"""
SELECT customer_id, CASE WHEN {q.is_missing('name')} THEN 'UNKNOWN' ELSE name END AS name FROM dirty_customers""")
def required_names(spark: SparkSession, sf: str) -> DataFrame:
    """Missing names replaced by the placeholder."""
    return fixture(spark, sf, "dirty_customers").select("customer_id", rp.required_text(F.col("name")).alias("name"))


@operation("PRJ-10", uses=["dirty_items"], sql="""+
counts AS (SELECT lower(trim(flag)) AS norm, trim(flag) AS flag, count(*) AS n FROM dirty_items
             WHERE flag IS NOT NULL GROUP BY 1, 2),
best AS (SELECT norm, flag AS best FROM
  (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, flag) AS rn FROM counts) WHERE rn = 1)
SELECT item_id, best AS flag FROM dirty_items LEFT JOIN best ON lower(trim(flag)) = norm""")
def unified_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """Flags with every variant replaced by the most frequent spelling."""
    items = rp.trim_text(fixture(spark, sf, "dirty_items").select("item_id", "flag"))
    gate = pf.aggregate_columns(items, ["flag"], pf.spelling_measures)
    return rp.apply_spellings(items, pf.read_spellings(items, pf.gated(gate)))


@operation("PRJ-11", uses=["dirty_items"], sql=f"""
SELECT item_id, coalesce(price, 'UNKNOWN') AS price, discount,
  coalesce({q.plain_number('quantity')}, (SELECT median({q.plain_number('quantity')}) FROM dirty_items)) AS quantity,
  ship_date, coalesce(flag, 'UNKNOWN') AS flag FROM dirty_items""")
def imputed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Missing cells filled by the exact median or the placeholder."""
    items = fixture(spark, sf, "dirty_items")
    return single_table.impute(items, items.count())[0]


@operation("PRD-1", uses=["dirty_items"], sql=q.per_column(
    "dirty_items", q.ITEM_COLUMNS, n_missing=lambda c: f"count(*) FILTER (WHERE {q.is_missing(c)})",
    n_missing_word=lambda c: f"count(*) FILTER (WHERE {q.is_missing_word(c)})"))
def missing_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Missing cells per column by the narrow and the wide rule."""
    items = fixture(spark, sf, "dirty_items")
    return _per_column(items, n_missing=tx.is_missing, n_missing_word=tx.is_missing_word)


def _per_column(df: DataFrame, **conditions) -> DataFrame:
    wide = df.agg(*[F.struct(*[F.count_if(test(pf.quoted(c))).alias(n) for n, test in conditions.items()])
                    .alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(i).cast("bigint").alias("ordinal"), F.lit(c).alias("column_name"),
                     *[F.col(f"c{i}.{n}").alias(n) for n in conditions]) for i, c in enumerate(df.columns)]
    return wide.select(F.inline(F.array(*rows)))


def _matching(pattern: str):
    return lambda c: f"count(*) FILTER (WHERE regexp_matches({c}, {pattern}))"


@operation("PRD-2", uses=["dirty_items"], sql=q.per_column(
    "dirty_items", q.ITEM_COLUMNS, currency=_matching(q.CURRENCY), percent=_matching(q.PERCENT),
    comma_number=_matching(q.COMMA_NUMBER), iso_date=_matching(q.ISO)))
def format_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Cells per column that look like currency, percent, comma number or ISO date."""
    return _per_column(fixture(spark, sf, "dirty_items"), currency=tx.is_currency, percent=tx.is_percent,
                       comma_number=tx.is_comma_number, iso_date=tx.is_iso_date)


@operation("PRD-3", uses=["dirty_items"], sql=q.per_column(
    "dirty_items", q.ITEM_COLUMNS, dollar_only=_matching(q.DOLLAR_ONLY), percent_tight=_matching(q.PERCENT_TIGHT)))
def narrow_format_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Cells per column that look like dollars or a percent sign without a blank."""
    return _per_column(fixture(spark, sf, "dirty_items"), dollar_only=tx.is_dollar_only,
                       percent_tight=tx.is_percent_tight)


@operation("PRD-4", uses=["dirty_items"], sql=q.per_column(
    "dirty_items", q.ITEM_COLUMNS, plain_number=_matching(q.PLAIN_NUMBER), date_or_time=_matching(q.DATE_OR_TIME)))
def type_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Cells per column that read as a number or as a date."""
    return _per_column(fixture(spark, sf, "dirty_items"), plain_number=tx.is_plain_number,
                       date_or_time=tx.is_date_or_time)


@operation("PRD-5 AGG-6", uses=["dirty_orders"], sql="""
SELECT count(*) FILTER (WHERE trim(amount) <> amount OR regexp_matches(amount, '[^0-9.\\-]')) AS n_messy,
  count(amount) AS n_values FROM dirty_orders""")
def messy_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts that carry anything but digits, point and minus."""
    c = F.col("amount")
    return fixture(spark, sf, "dirty_orders").agg(F.count_if(tx.is_messy_number(c)).alias("n_messy"),
                                                  F.count(c).alias("n_values"))


@operation("PRD-6", uses=["dirty_customers"], sql="""
SELECT customer_id, name FROM dirty_customers WHERE trim(customer_id) <> customer_id OR upper(customer_id) <> customer_id""")
def noisy_customer_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose key has outer blanks or lower-case letters."""
    return two_table.noisy_keys(fixture(spark, sf, "dirty_customers")).select("customer_id", "name")


@operation("PRD-7 SET-4", uses=["dirty_items"], sql="""
SELECT item_id, coalesce(flag, 'UNKNOWN') AS flag, flag IS NULL AS set_aside FROM dirty_items""")
def unknown_row_split(spark: SparkSession, sf: str) -> DataFrame:
    """Rows holding the placeholder set aside; kept and set-aside rows together are the input."""
    items = fixture(spark, sf, "dirty_items").select("item_id", "flag")
    filled = rp.project(items, flag=rp.required_text(F.col("flag")))
    kept, bad = rp.split_rows(filled, rp.any_unknown(filled))
    return kept.withColumn("set_aside", F.lit(False)).unionByName(bad.withColumn("set_aside", F.lit(True)))


@operation("PRD-8", uses=["dirty_items"], sql=f"""
SELECT count(*) AS n_sampled, count(*) FILTER (WHERE regexp_matches(ship_date, {q.ISO})) AS n_matching FROM
  (SELECT ship_date FROM dirty_items WHERE ship_date IS NOT NULL ORDER BY item_id, ship_date LIMIT 1000)""")
def head_sample_of_dates(spark: SparkSession, sf: str) -> DataFrame:
    """ISO dates among the first 1000 non-null values in item order."""
    return pf.head_share(fixture(spark, sf, "dirty_items"), "ship_date", tx.is_iso_date, 1000, ["item_id", "ship_date"])


# --- two tables ----------------------------------------------------------------------------------------

def _keyed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    customers, orders = fixture(spark, sf, "dirty_customers"), fixture(spark, sf, "dirty_orders")
    key = tx.norm_key(F.col("customer_id"))
    return rp.project(customers, customer_id=key), rp.project(orders, customer_id=key)


_KNOWN = f"(SELECT {q.norm_key('customer_id')} FROM dirty_customers WHERE customer_id IS NOT NULL)"


@operation("JOIN-1", uses=["dirty_customers", "dirty_orders"], sql=f"""
SELECT order_id, {q.norm_key('customer_id')} AS customer_id, amount, order_date, status FROM dirty_orders
WHERE customer_id IS NULL OR {q.norm_key('customer_id')} NOT IN {_KNOWN}""")
def orphan_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose customer is absent."""
    customers, orders = _keyed(spark, sf)
    return rp.orphans(orders, customers)


@operation("JOIN-2", uses=["dirty_customers", "dirty_orders"], sql=f"""
SELECT order_id, {q.norm_key('customer_id')} AS customer_id, amount, order_date, status FROM dirty_orders
WHERE {q.norm_key('customer_id')} IN {_KNOWN}""")
def matched_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose customer exists."""
    customers, orders = _keyed(spark, sf)
    return rp.matched(orders, customers)


@operation("JOIN-1 JOIN-2", uses=["dirty_customers", "dirty_orders"], sql=f"""
SELECT order_id, {q.norm_key('customer_id')} AS customer_id,
  customer_id IS NULL OR {q.norm_key('customer_id')} NOT IN {_KNOWN} AS is_orphan FROM dirty_orders""")
def flagged_orders(spark: SparkSession, sf: str) -> DataFrame:
    """All orders with an orphan flag, both halves from one join."""
    customers, orders = _keyed(spark, sf)
    return rp.flag_orphans(orders, customers).select("order_id", "customer_id", "is_orphan")


@operation("JOIN-3", uses=["dirty_customers", "dirty_orders"], sql=f"""
SELECT count(*) AS orders_total, count(*) FILTER (WHERE lost) AS orphaned_orders,
  round(100.0 * count(*) FILTER (WHERE lost) / count(*), 6) AS orphan_pct
FROM (SELECT customer_id IS NOT NULL AND {q.norm_key('customer_id')} NOT IN {_KNOWN} AS lost FROM dirty_orders)""")
def referential_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphaned orders among all orders; orders without a key are not orphans here."""
    customers, orders = fixture(spark, sf, "dirty_customers"), fixture(spark, sf, "dirty_orders")
    return two_table.orphan_summary(orders, customers).withColumn("orphan_pct", F.round("orphan_pct", 6))


@operation("SRT-4 JOIN-3", uses=["dirty_customers", "dirty_orders"], sql=f"""
SELECT DISTINCT {q.norm_key('customer_id')} AS key FROM dirty_orders
WHERE customer_id IS NOT NULL AND {q.norm_key('customer_id')} NOT IN {_KNOWN} ORDER BY 1 LIMIT 5""")
def orphan_key_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The five smallest distinct orphan keys."""
    return two_table.orphan_examples(fixture(spark, sf, "dirty_orders"), fixture(spark, sf, "dirty_customers"))


@operation("JOIN-4", uses=["dirty_customers", "dirty_orders"], sql=f"""
SELECT count(*) FILTER (WHERE {q.norm_key('customer_id')} IN {_KNOWN}) AS good, count(customer_id) AS total
FROM dirty_orders""")
def key_match_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with an existing customer among orders with a key."""
    return sc.integrity(fixture(spark, sf, "dirty_orders"), fixture(spark, sf, "dirty_customers")).drop("dimension")


@operation("SET-1", uses=["dirty_customers"], sql="SELECT DISTINCT * FROM dirty_customers")
def distinct_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without exact copies."""
    return rp.drop_copies(fixture(spark, sf, "dirty_customers"))


@operation("UDF-1", uses=["dirty_customers", "dirty_orders"], sql=f"""
SELECT 'distinct_customers' AS name, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_customers)) AS n_rows
UNION ALL SELECT 'matched_orders', count(*) FILTER (WHERE {q.norm_key('customer_id')} IN {_KNOWN}) FROM dirty_orders
UNION ALL SELECT 'orphan_orders', count(*) FILTER (WHERE customer_id IS NULL OR {q.norm_key('customer_id')} NOT IN {_KNOWN})
FROM dirty_orders""")
def runs_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Rows given by three operations that are looked up and run by their names."""
    results = [run(name, spark, sf).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
               for name in ("distinct_customers", "matched_orders", "orphan_orders")]
    return reduce(DataFrame.unionByName, results)
