"""Scorecards: every dimension is a count of good cases out of a count of checked cases.

Counts stay exact LONGs until the last projection, so two engines (or two runs) cannot differ by
the order in which partial results are added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .profile import duplicate_counts, missing, missing_word, quoted

# --- fixed values: the two-table model and its required columns ---------------------------------
DIMENSIONS = ["completeness", "uniqueness", "validity", "consistency", "integrity", "key_hygiene"]
REQUIRED_CUSTOMER = ["customer_id", "name"]
REQUIRED_ORDER = ["order_id", "customer_id", "amount"]
# ------------------------------------------------------------------------------------------------


def percent(good: Column, total: Column, empty: float = 100.0) -> Column:
    return F.when(total > 0, F.lit(100.0) * good / total).otherwise(F.lit(empty))


Measure = tuple[str, Column, Column]  # dimension, aggregate of good cases, aggregate of checked cases


def _part(df: DataFrame, dimension: str, good: Column, total: Column) -> DataFrame:
    return df.select(F.lit(dimension).alias("dimension"), good.cast("bigint").alias("good"),
                     total.cast("bigint").alias("total"))


def measured(df: DataFrame, *measures: Measure) -> DataFrame:
    """(dimension, good, total) rows of several measures from one aggregate over one scan."""
    wide = df.agg(*[F.struct(F.lit(d).alias("dimension"), good.cast("bigint").alias("good"),
                             total.cast("bigint").alias("total")).alias(f"m{i}")
                    for i, (d, good, total) in enumerate(measures)])
    return wide.select(F.inline(F.array(*[F.col(f"m{i}") for i in range(len(measures))])))


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def completeness(df: DataFrame, required: list[str]) -> Measure:
    """Filled cells over the required columns."""
    present = [c for c in required if c in df.columns]
    return ("completeness", _sum([tx.count_where(~tx.is_missing(quoted(c))) for c in present]),
            F.count(F.lit(1)) * len(present))


def validity() -> Measure:
    """ISO dates and clean amounts over the non-null dates and amounts of the orders."""
    date, amount = F.col("order_date"), F.col("amount")
    return ("validity", tx.count_where(tx.is_iso_date(tx.strip(date))) + tx.count_where(tx.is_clean_number(amount)),
            F.count(date) + F.count(amount))


def key_hygiene(key: str = "customer_id") -> Measure:
    """Clean keys over non-null keys."""
    return "key_hygiene", tx.count_where(~tx.is_noisy_key(quoted(key))), F.count(quoted(key))


def uniqueness(df: DataFrame) -> DataFrame:
    """Distinct rows over rows."""
    return _part(duplicate_counts(df), "uniqueness", F.col("n_distinct"), F.col("n_rows"))


def consistency(df: DataFrame, column: str) -> DataFrame:
    """Groups written in one way over groups that differ only in case or outer blanks."""
    values = df.where(quoted(column).isNotNull()).select(quoted(column).cast("string").alias("value")).distinct()
    groups = values.groupBy(tx.spelling(F.col("value")).alias("norm")).agg(F.count(F.lit(1)).alias("n"))
    return _part(groups.agg(tx.count_where(F.col("n") == 1).alias("good"), F.count(F.lit(1)).alias("total")),
                 "consistency", F.col("good"), F.col("total"))


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """Normalised keys with their number of rows; a hot key is one row per task when shuffled."""
    return (df.where(quoted(key).isNotNull())
            .groupBy(tx.norm_key(quoted(key)).alias("key")).agg(F.count(F.lit(1)).alias("n")))


def matched_key_counts(orders: DataFrame, customers: DataFrame, key: str = "customer_id") -> DataFrame:
    """Order keys with their number of rows and whether the customer exists.

    Both sides are reduced to distinct keys first, so neither a hot customer nor a customer listed
    many times makes one task of the join larger than the others.
    """
    known = key_counts(customers, key).select("key", F.lit(True).alias("found"))
    return (key_counts(orders, key).join(known, "key", "left")
            .select("key", "n", F.col("found").isNotNull().alias("found")))


def integrity(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders whose customer exists over orders with a customer key."""
    found = matched_key_counts(orders, customers)
    good, total = F.sum(F.when(F.col("found"), F.col("n"))), F.sum("n")
    return measured(found, ("integrity", F.coalesce(good, F.lit(0)), F.coalesce(total, F.lit(0))))


def dimension_counts(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """(dimension, good, total) over both tables, one row per dimension."""
    parts = [measured(customers, completeness(customers, REQUIRED_CUSTOMER), key_hygiene()),
             measured(orders, completeness(orders, REQUIRED_ORDER), validity(), key_hygiene()),
             uniqueness(customers), uniqueness(orders), consistency(customers, "state"),
             consistency(orders, "status"), integrity(orders, customers)]
    return (reduce(DataFrame.unionByName, parts).groupBy("dimension")
            .agg(F.sum("good").alias("good"), F.sum("total").alias("total")))


def scorecard(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """The six dimensions and their mean in one row."""
    score = percent(F.col("good"), F.col("total"))
    scored = dimension_counts(customers, orders).select("dimension", score.alias("score"))
    each = [F.max(F.when(F.col("dimension") == d, F.col("score"))).alias(d) for d in DIMENSIONS]
    return scored.agg(*each).select(*DIMENSIONS, (_sum([F.col(d) for d in DIMENSIONS]) / len(DIMENSIONS))
                                    .alias("overall"))


# --- one table --------------------------------------------------------------------------------------

def generic_counts(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Cells, missing cells, rows, distinct rows and checked / good cells of the kind columns."""
    cells = df.agg(F.count(F.lit(1)).alias("n_rows"),
                   _sum([tx.count_where(missing(df, c)) for c in df.columns]).alias("n_missing"), *valid_counts(kinds))
    both = cells.unionByName(duplicate_counts(df).select("n_distinct"), allowMissingColumns=True)
    return both.agg(*[F.sum(n).alias(n) for n in ("n_rows", "n_missing", "n_checked", "n_valid", "n_distinct")])


def valid_counts(kinds: dict[str, str]) -> list[Column]:
    """Aggregates: non-null cells of the kind columns, and those already in clean form."""
    return [_sum([F.count(quoted(c)) for c in kinds] or [F.lit(0)]).cast("bigint").alias("n_checked"),
            _sum([tx.count_where(_is_valid(quoted(c), kind)) for c, kind in kinds.items()] or [F.lit(0)])
            .cast("bigint").alias("n_valid")]


def _is_valid(c: Column, kind: str) -> Column:
    return tx.is_iso_date(c) if kind == "date" else tx.parse_number(c).isNotNull()


def generic_score(df: DataFrame, kinds: dict[str, str], inconsistent: bool) -> DataFrame:
    """Completeness, uniqueness, validity, consistency and their mean, in one row.

    Consistency is all or nothing: 0 while any column has spelling variants, else 100.
    """
    counts = generic_counts(df, kinds)
    cells = F.greatest(F.col("n_rows"), F.lit(1)) * len(df.columns)
    scored = (counts
              .withColumn("completeness", F.lit(100.0) * (cells - F.col("n_missing")) / cells)
              .withColumn("uniqueness", percent(F.col("n_distinct"), F.col("n_rows")))
              .withColumn("validity", percent(F.col("n_valid"), F.col("n_checked")))
              .withColumn("consistency", F.lit(0.0 if inconsistent else 100.0)))
    return scored.withColumn("overall", (F.col("completeness") + F.col("uniqueness") + F.col("validity")
                                         + F.col("consistency")) / 4)


def missing_share(df: DataFrame) -> DataFrame:
    """Cells that a repair would have to invent: missing cells, all cells and their ratio."""
    counted = df.agg(_sum([tx.count_where(missing_word(df, c)) for c in df.columns]).alias("n_missing"),
                     (F.count(F.lit(1)) * len(df.columns)).alias("n_cells"))
    return counted.withColumn("share", F.col("n_missing") / F.greatest(F.col("n_cells"), F.lit(1)))
