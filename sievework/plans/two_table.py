"""The two-table jobs: inspect, repair and score customers with their orders."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import profile as pf
from ..operators import repair as rp
from ..operators import score as sc
from ..session import materialize

# Columns looked at for spelling variants and messy numbers in this data model.
CATEGORY_COLUMNS = ["state", "status"]
AMOUNT_COLUMNS = ["amount"]


def table_metrics(df: DataFrame, name: str) -> DataFrame:
    """(table, column, metric, value) rows of one table."""
    parts = [
        pf.duplicate_counts(df).select(F.inline(F.array(
            F.struct(F.lit("").alias("column"), F.lit("rows").alias("metric"), F.col("n_rows").alias("value")),
            F.struct(F.lit("").alias("column"), F.lit("duplicate_rows").alias("metric"), F.col("n_duplicates").alias("value"))))),
        pf.missing_counts(df).select("column", F.lit("missing").alias("metric"), F.col("n_missing").alias("value")),
    ]
    dates = [c for c in df.columns if "date" in c.lower()]
    if dates:
        styles = pf.date_style_census(df, dates)
        parts.append(styles.select("column", F.concat(F.lit("date style "), "style").alias("metric"),
                                   F.col("n").alias("value")))
    for c in [c for c in CATEGORY_COLUMNS if c in df.columns]:
        groups = pf.casing_variants(df, [c]).select("norm").distinct()
        parts.append(groups.agg(F.count(F.lit(1)).alias("value"))
                     .select(F.lit(c).alias("column"), F.lit("variant groups").alias("metric"), "value"))
    for c in [c for c in AMOUNT_COLUMNS if c in df.columns]:
        parts.append(df.agg(F.count_if(tx.is_messy_number(pf.quoted(c))).alias("value"))
                     .select(F.lit(c).alias("column"), F.lit("messy numbers").alias("metric"), "value"))
    return reduce(DataFrame.unionByName, parts).select(F.lit(name).alias("table"), "column", "metric", "value")


def orphan_summary(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orphaned orders among all orders, in one row; orders without a key are not counted as orphans."""
    lost = sc.matched_key_counts(orders, customers).where("NOT found")
    parts = (lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphaned_orders"))
             .unionByName(orders.agg(F.count(F.lit(1)).alias("orders_total")), allowMissingColumns=True))
    return (parts.agg(F.sum("orders_total").alias("orders_total"), F.sum("orphaned_orders").alias("orphaned_orders"))
            .withColumn("orphan_pct", sc.percent(F.col("orphaned_orders"), F.col("orders_total"), 0.0)))


def orphan_examples(orders: DataFrame, customers: DataFrame, n: int = 5) -> DataFrame:
    """The smallest distinct orphan keys."""
    return sc.matched_key_counts(orders, customers).where("NOT found").orderBy("key").limit(n).select("key")


def noisy_keys(df: DataFrame, key: str = "customer_id") -> DataFrame:
    return df.where(tx.is_noisy_key(pf.quoted(key)))


def inspect(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Both table profiles, the join report and the key noise as (table, column, metric, value)."""
    join = orphan_summary(orders, customers).select(F.inline(F.array(
        F.struct(F.lit("join").alias("table"), F.lit("customer_id").alias("column"),
                 F.lit("orders_total").alias("metric"), F.col("orders_total").alias("value")),
        F.struct(F.lit("join").alias("table"), F.lit("customer_id").alias("column"),
                 F.lit("orphaned_orders").alias("metric"), F.col("orphaned_orders").alias("value")))))
    noise = customers.agg(F.count_if(tx.is_noisy_key(F.col("customer_id"))).alias("value")).select(
        F.lit("customers").alias("table"), F.lit("customer_id").alias("column"),
        F.lit("noisy keys").alias("metric"), "value")
    return reduce(DataFrame.unionByName, [table_metrics(customers, "customers"), table_metrics(orders, "orders"),
                                          join, noise])


# --- repair ---------------------------------------------------------------------------------------

@dataclass
class TwoTableRepair:
    """Repaired tables, the orders set aside, and what is needed to tell what was done."""

    customers: DataFrame
    orders: DataFrame
    quarantine: DataFrame
    inputs: tuple[DataFrame, DataFrame]
    marked: tuple[DataFrame, DataFrame]

    def changelog(self) -> DataFrame:
        """(step, column, action, n_changed) rows.

        The repaired tables carry a mark for every rewritten cell, so most counts come from one scan
        of marks; the inputs are read again for their rows and keys only.
        """
        customers, orders = self.inputs
        marked_customers, marked_orders = self.marked
        key = F.col("customer_id")
        noisy = F.count_if(~key.eqNullSafe(tx.norm_key(key)))
        return reduce(DataFrame.unionByName, [
            _steps(customers, [(1, "customer_id", "normalised customer keys", noisy)]),
            _dropped(customers, marked_customers, "dropped duplicate customers"),
            _dropped(orders, marked_orders, "dropped duplicate orders"),
            _steps(marked_customers, [(3, "signup_date", "rewrote dates to ISO", F.count_if("__date")),
                                      (4, "state", "canonicalised categories", F.count_if("__category")),
                                      (6, "name", "filled missing names", F.count_if("__filled"))]),
            _steps(marked_orders, [(3, "order_date", "rewrote dates to ISO", F.count_if("__date")),
                                   (4, "status", "lower-cased categories", F.count_if("__category")),
                                   (5, "amount", "set unreadable amounts to zero", F.count_if("__filled")),
                                   (7, "customer_id", "quarantined orphaned orders", F.count_if("is_orphan"))])])


def _steps(df: DataFrame, steps: list[tuple[int, str, str, Column]]) -> DataFrame:
    """Changelog rows from one aggregate."""
    counted = df.agg(*[n.cast("bigint").alias(f"s{i}") for i, (_, _, _, n) in enumerate(steps)])
    rows = [F.struct(F.lit(step).cast("bigint").alias("step"), F.lit(column).alias("column"),
                     F.lit(action).alias("action"), F.col(f"s{i}").alias("n_changed"))
            for i, (step, column, action, _) in enumerate(steps)]
    return counted.select(F.inline(F.array(*rows)))


def _dropped(before: DataFrame, after: DataFrame, action: str) -> DataFrame:
    """Changelog row for the rows that are gone."""
    sizes = before.agg(F.count(F.lit(1)).alias("n")).unionByName(after.agg((-F.count(F.lit(1))).alias("n")))
    return _steps(sizes, [(2, "", action, F.sum("n"))])


def _norm_keys(df: DataFrame) -> DataFrame:
    return rp.project(df, customer_id=tx.norm_key(F.col("customer_id")))


def _marked(df: DataFrame, date: str, category: str, filled: Column, **fixes: Column) -> DataFrame:
    """Apply the fixes, with a mark per row for the date, category and filled cell they change."""
    marks = [(~F.col(date).eqNullSafe(fixes[date])).alias("__date"),
             (~F.col(category).eqNullSafe(fixes[category])).alias("__category"), filled.alias("__filled")]
    return df.select(*[fixes[c].alias(c) if c in fixes else pf.quoted(c) for c in df.columns], *marks)


def repair_customers(customers: DataFrame) -> DataFrame:
    """Keys, copies, dates, states and required names, with marks for what was changed."""
    return _marked(rp.drop_copies(_norm_keys(customers)), "signup_date", "state", tx.is_missing(F.col("name")),
                   signup_date=tx.rewrite_date(F.col("signup_date")), state=rp.canonical_category(F.col("state")),
                   name=rp.required_text(F.col("name")))


def repair_orders(orders: DataFrame) -> DataFrame:
    """Keys, copies, dates, statuses and amounts, with marks; orphans are still among them."""
    return _marked(rp.drop_copies(_norm_keys(orders)), "order_date", "status",
                   tx.to_number(F.col("amount")).isNull(), order_date=tx.rewrite_date(F.col("order_date")),
                   status=tx.spelling(F.col("status")), amount=rp.filled_amount(F.col("amount")))


def repair(customers: DataFrame, orders: DataFrame) -> TwoTableRepair:
    """Repair both tables and set orders without a customer aside.

    Each table is written once, after its one whole-row shuffle (and, for orders, the join that
    tells orphans); kept and quarantined orders are filters over those files.
    """
    fixed_customers = materialize(repair_customers(customers), "customers")
    fixed_orders = materialize(rp.flag_orphans(repair_orders(orders), fixed_customers), "orders")
    plain = orders.columns
    return TwoTableRepair(
        fixed_customers.select(*customers.columns), fixed_orders.where("NOT is_orphan").select(*plain),
        fixed_orders.where("is_orphan").select(*plain), (customers, orders), (fixed_customers, fixed_orders))


def before_after(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Scorecards before and after the repair, as (phase, six dimensions, overall).

    Each scorecard is one row and is computed on its own: one plan holding both would be replanned
    as a whole after each of its many small shuffles.
    """
    columns = [*sc.DIMENSIONS, "overall"]
    before = sc.scorecard(customers, orders).first()
    fixed = repair(customers, orders)
    after = sc.scorecard(fixed.customers, rp.project(fixed.orders, amount=F.col("amount").cast("string"))).first()
    rows = [("before", *[before[c] for c in columns]), ("after", *[after[c] for c in columns])]
    return customers.sparkSession.createDataFrame(rows, "phase string, " + ", ".join(f"{c} double" for c in columns))


def inject_defects(customers: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seven defect classes put into two clean tables keyed ``(id)`` / ``(id, customer)``.

    customers: id, name, state, signup_date; orders: id, customer, amount, order_date, status.
    Every choice depends on the row's own key only, so any number of tasks gives the same rows.
    """
    def spread(date: str, k: Column) -> Column:
        d = F.col(date)
        return (F.when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd"))
                .when(k % 3 == 1, F.date_format(d, "MM/dd/yyyy"))
                .otherwise(F.date_format(d, "d MMM yyyy")))

    k = F.col("id")
    key = F.concat(F.lit("C"), k.cast("string"))
    broken_customers = customers.select(
        F.when(k % 67 == 10, F.concat(F.lit(" "), key, F.lit(" "))).when(k % 67 == 20, F.lower(key))
        .otherwise(key).alias("customer_id"),
        F.when(k % 100 == 88, F.lit("")).when(k % 100 != 7, F.col("name")).alias("name"),
        F.when(k % 3 == 1, F.lower("state")).when(k % 3 == 2, F.concat(F.lit(" "), "state"))
        .otherwise(F.col("state")).alias("state"),
        spread("signup_date", k).alias("signup_date"),
        F.when(k % 13 != 0, F.concat(F.lit("customer"), k.cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(k % 50 == 3, 2).otherwise(1).alias("copies"))
    plain = F.col("amount").cast("decimal(18,2)").cast("string")
    broken_orders = orders.select(
        F.concat(F.lit("O"), k.cast("string")).alias("order_id"),
        F.concat(F.when(k % 17 == 0, "G").otherwise("C"), F.col("customer").cast("string")).alias("customer_id"),
        F.when(k % 250 == 16, F.lit(""))
        .when(k % 250 != 15, F.when(k % 3 == 0, plain)
              .when(k % 3 == 1, F.concat(F.lit("$"), F.format_number("amount", 2)))
              .otherwise(F.concat(F.lit("  "), plain, F.lit(" ")))).alias("amount"),
        spread("order_date", k).alias("order_date"),
        F.when(k % 3 == 1, F.upper("status")).when(k % 3 == 2, F.initcap("status"))
        .otherwise(F.col("status")).alias("status"),
        F.when(k % 100 == 3, 2).otherwise(1).alias("copies"))
    return _repeat(broken_customers), _repeat(broken_orders)


def _repeat(df: DataFrame) -> DataFrame:
    """Each row as often as its ``copies`` column says."""
    rows = df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.drop("copies", "__copy")
