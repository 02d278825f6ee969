"""Measurements of one all-text table.

Every measurement of all columns is one aggregate over one scan.  The results that steer later
steps (kinds, candidate columns) are one row per column, so reading them on the driver is bounded
by the width of the table and never by its rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

# --- fixed values: limits that decide the results ----------------------------------------------
KIND_SHARE = 0.5
ISO_SHARE = 0.99
PARSED_SHARE = 0.7
MAX_SPELLINGS = 60
TYPE_SHARE = 0.8
TOP_MISSING = 5
MAX_ISSUES = 8
KIND_WORDS = {"currency": "currency", "percent": "percentages",
              "comma_number": "comma-formatted numbers", "date": "non-ISO dates"}
KIND_ISSUE = "'{column}' stores {kind} as text (e.g. \"{example}\") — needs coercion"
SPELLING_ISSUE = "'{column}' has inconsistent categorical variants ({pairs})"
SPELLING_PAIR = "'{value}'→'{canonical}'"
COPIES_ISSUE = "{n} exact duplicate rows"
MISSING_ISSUE = "{n} missing values in '{column}'"
QUICK_KIND_ISSUE = "'{column}' stores {kind} as text (e.g. \"{example}\") — needs numeric coercion"
QUICK_COPIES_ISSUE = "{n} duplicate rows"
# -----------------------------------------------------------------------------------------------

COLUMNS_PER_AGGREGATE = 50  # keeps one generated method below the JVM's size limit

# approx_count_distinct with rsd 0.05 keeps 512 registers.  n distinct values fill at most n of
# them, so its linear count never exceeds 512 * ln(512 / (512 - n)): a column whose estimate is
# above this bound has more than MAX_SPELLINGS values for certain.  Columns below it are counted.
_RSD, _REGISTERS = 0.05, 512
SPELLING_GATE = math.ceil(_REGISTERS * math.log(_REGISTERS / (_REGISTERS - MAX_SPELLINGS)))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def missing(df: DataFrame, name: str) -> Column:
    """Null or empty text; for other types null or not-a-number."""
    return _by_type(df, name, tx.is_missing)


def missing_word(df: DataFrame, name: str) -> Column:
    """Like :func:`missing`, counting the texts that stand for a missing value too."""
    return _by_type(df, name, tx.is_missing_word)


def _by_type(df: DataFrame, name: str, text_rule) -> Column:
    c, kind = quoted(name), df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return text_rule(c)
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.isNull()


def aggregate_columns(df: DataFrame, columns: list[str], measures) -> dict[str, dict[str, object]]:
    """Evaluate ``measures(name, column) -> {label: aggregate}`` for many columns, one row back.

    Wide tables are done in batches of columns; each batch reads only its own columns.
    """
    found: dict[str, dict[str, object]] = {}
    for start in range(0, len(columns), COLUMNS_PER_AGGREGATE):
        batch = columns[start:start + COLUMNS_PER_AGGREGATE]
        labels, aggs = [], []
        for i, name in enumerate(batch):
            for label, agg in measures(name, quoted(name)).items():
                labels.append((name, label))
                aggs.append(agg.alias(f"m{len(labels) - 1}"))
        row = df.agg(*aggs).first()
        for (name, label), value in zip(labels, row):
            found.setdefault(name, {})[label] = value
    return found


def watch_columns(df: DataFrame, columns: list[str], measures) -> tuple[DataFrame, Callable[[], dict[str, dict[str, object]]]]:
    """``df`` that evaluates ``measures`` while it is written, and what reads them once it is.

    Spares the pass of :func:`aggregate_columns` over a table about to be written.  Spark counts each partition
    of the last stage once, however often its tasks are tried.
    """
    taken = []
    for start in range(0, len(columns), COLUMNS_PER_AGGREGATE):
        labelled = [(name, label, agg) for name in columns[start:start + COLUMNS_PER_AGGREGATE]
                    for label, agg in measures(name, quoted(name)).items()]
        watch = Observation()
        df = df.observe(watch, *[agg.alias(f"m{i}") for i, (_, _, agg) in enumerate(labelled)])
        taken.append((watch, labelled))

    def read() -> dict[str, dict[str, object]]:
        found: dict[str, dict[str, object]] = {}
        for watch, labelled in taken:
            values = watch.get
            for i, (name, label, _) in enumerate(labelled):
                found.setdefault(name, {})[label] = values[f"m{i}"]
        return found

    return df, read


def long_counts(df: DataFrame, columns: list[str], condition, name: str = "n") -> DataFrame:
    """One row per column with the number of rows meeting ``condition(name)``; wide tables go in batches of columns."""
    parts = []
    for start in range(0, max(len(columns), 1), COLUMNS_PER_AGGREGATE):
        batch = list(enumerate(columns))[start:start + COLUMNS_PER_AGGREGATE]
        wide = df.agg(*[tx.count_where(condition(c)).alias(f"c{i}") for i, c in batch])
        parts.append(wide.select(F.inline(F.array(*[
            F.struct(F.lit(i).cast("bigint").alias("ordinal"), F.lit(c).alias("column"), F.col(f"c{i}").alias(name))
            for i, c in batch]))))
    return reduce(DataFrame.unionByName, parts)


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing cells per column, in column order."""
    return long_counts(df, df.columns, lambda name: missing(df, name), "n_missing")


def top_missing(df: DataFrame, n: int = TOP_MISSING) -> DataFrame:
    """The columns with most missing cells; ties in column order, complete columns left out."""
    return (missing_counts(df).where("n_missing > 0")
            .orderBy(F.desc("n_missing"), F.asc("ordinal")).limit(n))


def multiplicities(df: DataFrame) -> DataFrame:
    """Distinct rows with the number of their copies.

    Copies collapse in each task before the shuffle, so a row repeated any number of times travels
    at most once per task.
    """
    return df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))


def row_digest(df: DataFrame) -> list[Column]:
    """128 bits that stand for a whole row: equal rows agree, nulls counting as equal.

    Hashes pass over nulls, so every cell goes in with a flag that says whether it is one.  Zero is
    given one sign, as grouping does.
    """
    cells = []
    for f in df.schema.fields:
        c = quoted(f.name)
        cells += [c + F.lit(0.0).cast(f.dataType) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c, c.isNull()]
    return [F.xxhash64(*cells).alias("__d1"), F.xxhash64(F.lit("again"), *reversed(cells)).alias("__d2")]


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and exact duplicates (nulls equal) in one row.

    Rows are told apart by 128-bit digests, so 16 bytes a row are shuffled instead of the row.  Two
    different rows out of a trillion share a digest with a chance below 10^-14.  Tables with maps,
    which have no hash, are grouped by whole rows.
    """
    if "map<" in df.schema.simpleString():
        counts = multiplicities(df)
    else:
        counts = df.select(*row_digest(df)).groupBy("__d1", "__d2").agg(F.count(F.lit(1)).alias("__copies"))
    counts = counts.agg(F.coalesce(F.sum("__copies"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))
    return counts.withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def date_style_census(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """How many values of each date column use which spelling."""
    columns = columns or [c for c in df.columns if "date" in c.lower()]
    return (unpivot(df, columns).where("value IS NOT NULL")
            .groupBy("column", tx.date_style(F.col("value")).alias("style"))
            .agg(F.count(F.lit(1)).alias("n")))


def unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) rows of the chosen columns."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value"))
                      for c in columns])
    return df.select(F.inline(cells))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null values of each column with their number."""
    return (unpivot(df, columns).where("value IS NOT NULL")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def casing_variants(df: DataFrame, columns: list[str]) -> DataFrame:
    """Groups of values that differ only in case or outer blanks, one row per spelling."""
    counted = value_counts(df, columns).withColumn("norm", tx.spelling(F.col("value")))
    sizes = counted.groupBy("column", "norm").agg(F.count(F.lit(1)).alias("n_spellings"))
    return (counted.join(sizes.where("n_spellings > 1"), ["column", "norm"])
            .select("column", "norm", "value", "n", "n_spellings"))


# --- kinds ---------------------------------------------------------------------------------------

def kind_measures(name: str, c: Column) -> dict[str, Column]:
    measures = {
        "values": F.count(c),
        "currency": tx.count_where(tx.is_currency(c)),
        "percent": tx.count_where(tx.is_percent(c)),
        "comma_number": tx.count_where(tx.is_comma_number(c)),
        "example": F.min(c),
    }
    if "date" in name.lower():
        measures["iso"] = tx.count_where(tx.is_iso_date(c))
        measures["parsed"] = tx.count_where(tx.parse_date(c).isNotNull())
    return measures


def kind_of(m: dict[str, object]) -> str | None:
    """Kind of a column from its counts; the first rule that holds decides."""
    values = m["values"]
    if not values:
        return None
    for kind in ("currency", "percent", "comma_number"):
        if m[kind] / values > KIND_SHARE:
            return kind
    if "iso" in m and m["iso"] / values < ISO_SHARE and m["parsed"] / values > PARSED_SHARE:
        return "date"
    return None


def column_kinds(df: DataFrame) -> DataFrame:
    """Kind of every column that hides numbers or dates in text: (ordinal, column, kind, example)."""
    columns = text_columns(df)
    wide = df.agg(*[F.struct(*[a.alias(k) for k, a in kind_measures(c, quoted(c)).items()]).alias(f"c{i}")
                    for i, c in enumerate(columns)])
    rows = []
    for i, c in enumerate(columns):
        m = F.col(f"c{i}")
        kind = reduce(lambda done, k: done.when(m[k] / m["values"] > KIND_SHARE, k),
                      ("percent", "comma_number"), F.when(m["currency"] / m["values"] > KIND_SHARE, "currency"))
        if "date" in c.lower():
            kind = kind.when((m["iso"] / m["values"] < ISO_SHARE) & (m["parsed"] / m["values"] > PARSED_SHARE), "date")
        rows.append(F.struct(F.lit(df.columns.index(c)).cast("bigint").alias("ordinal"), F.lit(c).alias("column"),
                             F.when(m["values"] > 0, kind).alias("kind"), m["example"].alias("example")))
    return wide.select(F.inline(F.array(*rows))).where("kind IS NOT NULL")


def head_share(df: DataFrame, column: str, predicate, n: int, order_by: list[str]) -> DataFrame:
    """Share of the first ``n`` non-null values, in a stated order, that meet a predicate."""
    c = quoted(column)
    head = df.where(c.isNotNull()).orderBy(*order_by).limit(n)
    return head.agg(F.count(F.lit(1)).alias("n_sampled"), tx.count_where(predicate(c)).alias("n_matching"))


# --- spellings -----------------------------------------------------------------------------------

def spelling_measures(name: str, c: Column) -> dict[str, Column]:
    return {"spellings": F.approx_count_distinct(c, _RSD)}


def spelling_map(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variant -> canonical rows (column, value, canonical, n) for low-cardinality columns.

    Only columns with at most MAX_SPELLINGS values count, and only groups with more than one
    spelling give rows.  The most frequent spelling is canonical, the smallest on a tie.
    ``columns`` should have passed the SPELLING_GATE; the exact limit is applied here.
    """
    schema = "column string, value string, canonical string, n bigint"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    counted = value_counts(df, columns).withColumn("norm", tx.spelling(F.col("value")))
    few = (counted.withColumn("n_values", F.count(F.lit(1)).over(Window.partitionBy("column")))
           .where(F.col("n_values") <= MAX_SPELLINGS))
    best_first = Window.partitionBy("column", "norm").orderBy(F.desc("n"), F.asc("value"))
    return (few.withColumn("canonical", F.first("value").over(best_first))
            .where("value <> canonical").select("column", "value", "canonical", "n"))


# --- the one-table profile -------------------------------------------------------------------------

@dataclass
class TableProfile:
    """What a profile found; sized by the columns of the table, not by its rows."""

    columns: list[str]
    n_rows: int = 0
    n_duplicates: int = 0
    missing: dict[str, int] = field(default_factory=dict)
    holes: dict[str, int] = field(default_factory=dict)
    trimmed: dict[str, int] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)
    examples: dict[str, str] = field(default_factory=dict)
    spellings: dict[str, dict[str, str]] = field(default_factory=dict)
    trimmed_spellings: dict[str, dict[str, str]] = field(default_factory=dict)

    @property
    def n_missing(self) -> int:
        return sum(self.missing.values())

    @property
    def hole_share(self) -> float:
        """Share of cells a repair would have to invent, by the wide rule for missing cells."""
        return sum(self.holes.values()) / max(self.n_rows * len(self.columns), 1)

    @property
    def issues(self) -> list[str]:
        found = [KIND_ISSUE.format(column=c, kind=KIND_WORDS[k], example=self.examples[c])
                 for c, k in self.kinds.items()]
        for column, variants in self.spellings.items():
            shown = [SPELLING_PAIR.format(value=a, canonical=b) for a, b in list(variants.items())[:2]]
            found.append(SPELLING_ISSUE.format(column=column, pairs=", ".join(shown)))
        if self.n_duplicates:
            found.append(COPIES_ISSUE.format(n=self.n_duplicates))
        return found + self.missing_issues()

    def missing_issues(self) -> list[str]:
        worst = sorted(self.missing.items(), key=lambda item: -item[1])[:TOP_MISSING]
        return [MISSING_ISSUE.format(n=n, column=c) for c, n in worst if n]


def read_spellings(df: DataFrame, columns: list[str]) -> dict[str, dict[str, str]]:
    """The spelling map on the driver: at most MAX_SPELLINGS rows per column, by construction."""
    maps: dict[str, dict[str, str]] = {}
    for row in sorted(spelling_map(df, columns).collect()):
        maps.setdefault(row["column"], {})[row["value"]] = row["canonical"]
    return {c: maps[c] for c in columns if c in maps}


def gated(measured: dict[str, dict[str, object]]) -> list[str]:
    """Columns that may have few enough values to be checked for spelling variants."""
    return [c for c, m in measured.items() if 0 < m["spellings"] <= SPELLING_GATE]


def profile_table(df: DataFrame) -> TableProfile:
    """Rows, duplicates, missing cells, kinds and spelling variants of one table.

    Besides the spelling variants of the cells as they are, those that remain after trimming are
    found for the same columns, since a repair trims first.
    """
    texts = text_columns(df)
    copies = duplicate_counts(df).first()
    profile = TableProfile(columns=df.columns, n_rows=copies["n_rows"], n_duplicates=copies["n_duplicates"])

    def measures(name: str, c: Column) -> dict[str, Column]:
        found = {"missing": tx.count_where(missing(df, name)), "holes": tx.count_where(missing_word(df, name))}
        if name in texts:
            found |= kind_measures(name, c) | spelling_measures(name, c)
            found["trimmed"] = tx.count_where(~c.eqNullSafe(tx.strip(c)))
        return found

    measured = aggregate_columns(df, df.columns, measures)
    profile.missing = {c: m["missing"] for c, m in measured.items()}
    profile.holes = {c: m["holes"] for c, m in measured.items()}
    for c in texts:
        kind = kind_of(measured[c])
        if kind:
            profile.kinds[c], profile.examples[c] = kind, measured[c]["example"]
    measured = {c: measured[c] for c in texts}
    profile.trimmed = {c: m["trimmed"] for c, m in measured.items()}
    # both maps from one pass: a column as it is, and a trimmed twin under a marked name where trimming changes a cell
    few = gated(measured)
    twins = [c for c in few if profile.trimmed[c]]
    both = df.select(*[quoted(c) for c in few], *[tx.strip(quoted(c)).alias(f"{c}\u0001") for c in twins])
    maps = read_spellings(both, both.columns)
    profile.spellings = {c: maps[c] for c in few if c in maps}
    trimmed = {c: maps.get(f"{c}\u0001" if c in twins else c) for c in few}
    profile.trimmed_spellings = {c: m for c, m in trimmed.items() if m}
    return profile


def profile_metrics(profile: TableProfile) -> list[tuple[str, str | None, str]]:
    """A profile as (metric, column, value) rows."""
    rows = [("rows", None, str(profile.n_rows)), ("columns", None, str(len(profile.columns))),
            ("duplicate_rows", None, str(profile.n_duplicates)), ("missing_cells", None, str(profile.n_missing))]
    rows += [("missing", c, str(n)) for c, n in profile.missing.items()]
    rows += [("kind", c, k) for c, k in profile.kinds.items()]
    rows += [("spelling_variants", c, str(len(m))) for c, m in profile.spellings.items()]
    return rows


def quick_profile(df: DataFrame, truncated: bool = False) -> dict[str, object]:
    """The short profile: completeness, uniqueness, their mean and at most eight issues."""
    copies = duplicate_counts(df).first()
    measured = aggregate_columns(df, df.columns, lambda name, c: {
        "missing": tx.count_where(tx.is_missing(c)), "values": F.count(c), "example": F.min(c),
        "currency": tx.count_where(tx.is_dollar_only(c)), "percent": tx.count_where(tx.is_percent_tight(c))})
    profile = TableProfile(df.columns, copies["n_rows"], copies["n_duplicates"],
                           {c: m["missing"] for c, m in measured.items()})
    issues = []
    for c, m in measured.items():
        for kind, word in (("currency", "currency"), ("percent", "percentages")):
            if m["values"] and m[kind] / m["values"] > KIND_SHARE:
                issues.append(QUICK_KIND_ISSUE.format(column=c, kind=word, example=m["example"]))
                break
    if profile.n_duplicates:
        issues.append(QUICK_COPIES_ISSUE.format(n=profile.n_duplicates))
    issues += profile.missing_issues()
    cells = profile.n_rows * len(df.columns)
    completeness = 100.0 * (1 - profile.n_missing / cells) if cells else 100.0
    uniqueness = 100.0 * (1 - profile.n_duplicates / profile.n_rows) if profile.n_rows else 100.0
    return {"rows": profile.n_rows, "truncated": truncated, "columns": df.columns,
            "duplicate_rows": profile.n_duplicates, "missing_cells": profile.n_missing,
            "completeness": completeness, "uniqueness": uniqueness,
            "overall": (completeness + uniqueness) / 2, "issues": issues[:MAX_ISSUES]}
