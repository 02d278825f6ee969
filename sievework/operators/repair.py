"""Repairs: projections that fix cells, and splits that set rows aside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .profile import missing_word, quoted, text_columns

# --- fixed values: spellings of the states the reference data uses -------------------------------
STATE_NAMES = {"ca": "CA", "california": "CA", "ny": "NY", "new york": "NY", "tx": "TX", "texas": "TX"}
# ---------------------------------------------------------------------------------------------------


def project(df: DataFrame, **changed: Column) -> DataFrame:
    """Replace columns in place, in one projection."""
    return df.select(*[changed[c].alias(c) if c in changed else quoted(c) for c in df.columns])


def trim_text(df: DataFrame) -> DataFrame:
    """Strip outer white space from every text column."""
    return project(df, **{c: tx.strip(quoted(c)) for c in text_columns(df)})


def drop_copies(df: DataFrame) -> DataFrame:
    """Keep one of each set of identical rows; copies collapse before the shuffle."""
    return df.dropDuplicates()


def literal_lookup(c: Column, mapping: dict[str, str]) -> Column:
    """Replace a value by its entry in a small mapping; other values stay."""
    if not mapping:
        return c
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.element_at(pairs, c), c)


def canonical_category(c: Column, mapping: dict[str, str] = STATE_NAMES) -> Column:
    """Dictionary entry of a category, else the category in upper case without outer blanks."""
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.element_at(pairs, tx.spelling(c)), F.upper(tx.strip(c)))


def filled_amount(c: Column) -> Column:
    return F.coalesce(tx.to_number(c), F.lit(0.0))


def required_text(c: Column) -> Column:
    return F.when(tx.is_missing(c), F.lit(tx.UNKNOWN)).otherwise(c)


def coerce_kinds(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Dates to ISO text, every other kind to a number."""
    return project(df, **{c: tx.to_iso(quoted(c)) if kind == "date" else tx.to_number(quoted(c))
                          for c, kind in kinds.items()})


def apply_spellings(df: DataFrame, spellings: dict[str, dict[str, str]]) -> DataFrame:
    """Variant -> canonical per column; at most 60 pairs each, so they travel in the plan."""
    texts = set(text_columns(df))
    return project(df, **{c: literal_lookup(quoted(c), m) for c, m in spellings.items() if c in texts})


def as_number(df: DataFrame, column: str) -> Column:
    """A column read as numbers, whatever its type."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return tx.parse_number(quoted(column))
    return quoted(column).cast("double")


def fill_missing(df: DataFrame, medians: dict[str, float], placeholders: list[str],
                 all_numeric: set[str]) -> DataFrame:
    """Median into missing cells of numeric columns, the placeholder word into the other columns.

    A text column whose filled cells are all numeric becomes a number column.  Where some cells are
    other text, those cells are kept and only the missing ones are filled.
    """
    changed: dict[str, Column] = {}
    for c, median in medians.items():
        if c in all_numeric:
            changed[c] = F.coalesce(as_number(df, c), F.lit(median))
        else:
            changed[c] = F.when(missing_word(df, c), F.lit(median).cast("string")).otherwise(quoted(c))
    for c in placeholders:
        changed[c] = F.when(missing_word(df, c), F.lit(tx.UNKNOWN)).otherwise(quoted(c).cast("string"))
    return project(df, **changed)


def any_unknown(df: DataFrame) -> Column:
    """True for rows in which any text cell is the placeholder; never null."""
    cells = F.array(*[quoted(c) for c in text_columns(df)])
    return F.coalesce(F.exists(cells, lambda x: x.isNotNull() & (x == tx.UNKNOWN)), F.lit(False))


def any_missing(df: DataFrame) -> Column:
    """True for rows in which any cell is missing."""
    return reduce(lambda a, b: a | b, [missing_word(df, c) for c in df.columns])


def split_rows(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, set aside): the two together are the input."""
    return df.where(~F.coalesce(bad, F.lit(False))), df.where(F.coalesce(bad, F.lit(False)))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.where(quoted(key).isNotNull()).select(quoted(key)).distinct()


def orphans(orders: DataFrame, customers: DataFrame, key: str = "customer_id") -> DataFrame:
    """Orders whose customer is absent; a null key has no customer either."""
    return orders.join(distinct_keys(customers, key), key, "left_anti").select(*orders.columns)


def matched(orders: DataFrame, customers: DataFrame, key: str = "customer_id") -> DataFrame:
    """Orders whose customer exists."""
    return orders.join(distinct_keys(customers, key), key, "left_semi").select(*orders.columns)


def flag_orphans(orders: DataFrame, customers: DataFrame, key: str = "customer_id",
                 flag: str = "is_orphan") -> DataFrame:
    """Orders with a flag telling whether the customer is absent: both halves from one join.

    The customer side holds each key once.  The order side may hold a hot key; it is the streamed
    side of an outer join, so the adaptive planner can split its oversized partitions.  Orders
    without a key never enter the shuffle as one group: they get scattered, unmatched join keys.
    """
    known = distinct_keys(customers, key).select(quoted(key).alias("__known"))
    scattered = F.concat(F.lit("\u0000"), F.xxhash64(*[quoted(c) for c in orders.columns]).cast("string"))
    keyed = orders.withColumn("__key", F.coalesce(quoted(key), scattered))
    joined = keyed.join(known, keyed["__key"] == known["__known"], "left")
    return joined.select(*[quoted(c) for c in orders.columns], F.col("__known").isNull().alias(flag))
