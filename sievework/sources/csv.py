"""All-text CSV tables: reading with the usual missing-value words, and writing."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import quoted, text_columns
from ..operators.repair import project
from . import records

# --- fixed values: cells read as missing ---------------------------------------------------------------
NA_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
            "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
CSV_SUFFIXES = r"(?i)\.csv(\.gz)?$"
# ---------------------------------------------------------------------------------------------------------


def _reader(spark: SparkSession, multi_line: bool = True):
    return spark.read.options(header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line,
                              enforceSchema=False)


def null_words(df: DataFrame) -> DataFrame:
    """Null every cell that holds one of the words for a missing value."""
    return project(df, **{c: F.when(~quoted(c).isin(NA_WORDS), quoted(c)) for c in text_columns(df)})


def read_text_table(spark: SparkSession, *paths: str, max_rows: int | None = None,
                    multi_line: bool = True, split: bool | None = None) -> DataFrame:
    """CSV files (plain or gzip) with a header as one table of text columns.

    Quoted cells may span lines.  A delivery of small files is read by a task a file; where one is larger than
    a block of ``spark.sql.files.maxPartitionBytes``, or with ``split=True``, records are found block by block
    (:mod:`records`), so that one large file is read by many tasks.  With ``multi_line=False`` no cell may span lines.  A
    gzip file cannot be split: its rows are spread again before further work.  ``max_rows`` keeps
    the first rows only; by default everything is read.
    """
    if split is None:
        split = multi_line and not max_rows and records.largest_file(spark, *paths) > _block_bytes(spark)
    df = null_words(_split_table(spark, *paths) if split else _reader(spark, multi_line).csv(list(paths)))
    if any(p.lower().endswith(".gz") for p in paths):
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df.limit(max_rows) if max_rows else df


def _block_bytes(spark: SparkSession) -> int:
    """``spark.sql.files.maxPartitionBytes`` in bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def _split_table(spark: SparkSession, *paths: str) -> DataFrame:
    """The table of :func:`_reader` by records found block by block; a header other than the first file's stops the job."""
    schema = _reader(spark).csv(list(paths)).schema
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    names = F.struct(*(F.lit(c).alias(c) for c in schema.names))
    ddl = ", ".join("`" + c.replace("`", "``") + "` string" for c in schema.names)
    parsed = records.records(spark, *paths).select("first", F.from_csv("record", ddl, options).alias("row"))
    return parsed.where(F.when(F.col("first") & (F.col("row") != names), F.raise_error("headers of the files differ").cast("boolean"))
                        .otherwise(~F.col("first"))).select("row.*")


@dataclass
class CappedTable:
    table: DataFrame
    truncated: bool


def read_capped(spark: SparkSession, path: str, max_rows: int) -> CappedTable:
    """The first rows of a file and whether there were more."""
    more = _reader(spark).csv(path).limit(max_rows + 1).count() > max_rows
    return CappedTable(read_text_table(spark, path, max_rows=max_rows), more)


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """(header, files): the CSV files below a folder by their first line."""
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value",
        F.monotonically_increasing_id().alias("position"))
    first = (lines.where(F.col("file").rlike(CSV_SUFFIXES) & (F.col("start") == 0))
             .groupBy("file").agg(F.min_by("value", "position").alias("header")))
    return first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))


def profile_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Short profile of every file of one schema, in one job: a row per file.

    (file, n_rows, duplicate_rows, missing_cells, completeness, uniqueness, overall)
    """
    raw = _reader(spark).csv(paths).select("*", F.col("_metadata.file_path").alias("__file"))
    columns = raw.columns[:-1]
    table = null_words(raw)
    copies = table.groupBy(*[quoted(c) for c in table.columns]).agg(F.count(F.lit(1)).alias("__n"))
    holes = reduce(lambda a, b: a + b, [F.when(quoted(c).isNull(), 1).otherwise(0) for c in columns])
    per_file = copies.groupBy(F.col("__file").alias("file")).agg(
        F.sum("__n").alias("n_rows"), F.sum(F.col("__n") - 1).alias("duplicate_rows"),
        F.sum(holes * F.col("__n")).alias("missing_cells"))
    complete = F.lit(100.0) * (1 - F.col("missing_cells") / (F.col("n_rows") * len(columns)))
    unique = F.lit(100.0) * (1 - F.col("duplicate_rows") / F.col("n_rows"))
    return (per_file.withColumn("completeness", complete).withColumn("uniqueness", unique)
            .withColumn("overall", (complete + unique) / 2))


def profile_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Short profile of every CSV file below a folder: one distributed job per schema, not per file."""
    groups = [profile_files(spark, row["files"]) for row in headers(spark, folder).orderBy("header").collect()]
    if not groups:
        return spark.createDataFrame([], "file string, n_rows bigint, duplicate_rows bigint, missing_cells bigint, "
                                         "completeness double, uniqueness double, overall double")
    return reduce(DataFrame.unionByName, groups)


def file_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, n_rows) of the CSV files of one schema below a folder, in one scan."""
    return (_reader(spark).option("recursiveFileLookup", "true").csv(folder)
            .groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows")))


def rows_as_text(df: DataFrame) -> DataFrame:
    """Each row as one searchable line, cells separated by blanks, missing cells written as NaN."""
    cells = [F.coalesce(quoted(c).cast("string"), F.lit("NaN")) for c in df.columns]
    return df.select(F.concat_ws("  ", *cells).alias("line"))


def json_cells(df: DataFrame, **schemas: str) -> DataFrame:
    """Parse the named text columns as JSON of the given types; a cell that does not parse is null."""
    return project(df, **{c: F.from_json(quoted(c), schema) for c, schema in schemas.items()})


def write_table(df: DataFrame, path: str, format: str = "csv") -> str:
    """Write a table as CSV with a header, or as Parquet."""
    writer = df.write.mode("overwrite")
    if format == "csv":
        writer.options(header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
                       ignoreTrailingWhiteSpace=False).csv(path)
    else:
        writer.format(format).save(path)
    return path


def write_if_any(df: DataFrame, path: str, format: str = "csv") -> str | None:
    """Write a table only if it has rows."""
    return None if df.isEmpty() else write_table(df, path, format)


def write_repair(clean: DataFrame, quarantine: DataFrame, folder: str, stem: str, format: str = "parquet"):
    """``<stem>_clean`` and, if there are any, ``<stem>_quarantined``."""
    return (write_table(clean, f"{folder}/{stem}_clean", format),
            write_if_any(quarantine, f"{folder}/{stem}_quarantined", format))


def all_text(df: DataFrame) -> DataFrame:
    """Every column as text, as a CSV reader would give it."""
    return df.select(*[quoted(f.name) if isinstance(f.dataType, T.StringType) else quoted(f.name).cast("string")
                       .alias(f.name) for f in df.schema.fields])
