"""Sources and sinks, over files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking as ck
from ..operators import profile as pf
from ..plans import single_table
from ..registry import operation
from ..session import work_path
from ..sources import csv, files, state
from ..sources.tables import fixture, table
from . import snippets as q


def _written_csv(spark: SparkSession, sf: str, name: str) -> str:
    return csv.write_table(fixture(spark, sf, name), work_path(spark, name))


@operation("SRC-1 SNK-1", uses=["dirty_items"], sql="SELECT " + ", ".join(
    f"nullif({c}, '') AS {c}" for c in q.ITEM_COLUMNS) + " FROM dirty_items")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Items written as CSV and read back as text; empty cells come back as missing."""
    return csv.read_text_table(spark, _written_csv(spark, sf, "dirty_items"))


@operation("SRC-1", uses=["dirty_items"], sql="SELECT " + ", ".join(
    f"nullif({c}, '') AS {c}" for c in q.ITEM_COLUMNS) + """, concat(item_id, chr(10), '"', coalesce(flag, ''), '", ', chr(10), chr(10), 'x') AS note
FROM dirty_items""")
def csv_by_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Items with line breaks, quotes and commas in a cell, written as CSV and read block by block."""
    noted = fixture(spark, sf, "dirty_items").withColumn("note", F.concat(
        F.col("item_id"), F.lit('\n"'), F.coalesce("flag", F.lit("")), F.lit('", \n\nx')))
    return csv.read_text_table(spark, csv.write_table(noted, work_path(spark, "noted-items")), split=True)


@operation("SRC-1", uses=["dirty_orders"], sql=q.per_column(
    "dirty_orders", q.ORDER_COLUMNS, n_missing=lambda c: f"count(*) FILTER (WHERE {q.is_missing(c)})"))
def gzip_csv_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Missing cells of the orders read from gzip-compressed CSV."""
    path = work_path(spark, "orders-gz")
    fixture(spark, sf, "dirty_orders").write.options(header=True, escape='"', compression="gzip").csv(path)
    return pf.missing_counts(csv.read_text_table(spark, path)).withColumnRenamed("column", "column_name")


@operation("SRC-2", uses=["dirty_customers"], sql="""
SELECT least(count(*), 100) AS n_rows, count(*) > 100 AS truncated FROM dirty_customers""")
def capped_read(spark: SparkSession, sf: str) -> DataFrame:
    """A capped read of the customers with its flag telling that there were more rows."""
    capped = csv.read_capped(spark, _written_csv(spark, sf, "dirty_customers"), 100)
    return capped.table.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("truncated", F.lit(capped.truncated))


@operation("SRC-3", uses=["feed_v1", "feed_v2"], sql="""
SELECT 'feed_v1' AS feed, count(*) AS n_rows, CAST(100 AS DOUBLE) AS completeness FROM feed_v1
UNION ALL SELECT 'feed_v2', count(*), CAST(100 AS DOUBLE) FROM feed_v2""")
def folder_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Short profile of every CSV file below a folder, summed per feed."""
    folder = work_path(spark, "feeds")
    for feed in ("feed_v1", "feed_v2"):
        csv.write_table(fixture(spark, sf, feed), f"{folder}/{feed}")
    feed = F.regexp_extract("file", r"([^/]*)/[^/]*$", 1).alias("feed")
    return csv.profile_folder(spark, folder).groupBy(feed).agg(F.sum("n_rows").alias("n_rows"), F.min("completeness").alias("completeness"))


@operation("SRC-3", uses=["dirty_customers"], sql="SELECT count(*) AS n_rows FROM dirty_customers")
def file_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per CSV file of one schema, added up."""
    counts = csv.file_row_counts(spark, _written_csv(spark, sf, "dirty_customers"))
    return counts.agg(F.sum("n_rows").alias("n_rows"))


def _document_folder(spark: SparkSession, sf: str) -> str:
    """Documents as text files, one each."""
    return files.write_texts(table(spark, sf, "documents"), "text", work_path(spark, "documents"))


@operation("SRC-4", sql="SELECT count(*) AS n_files, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n_bytes FROM documents")
def found_files(spark: SparkSession, sf: str) -> DataFrame:
    """Document files below a folder."""
    found = files.find_files(spark, _document_folder(spark, sf))
    return found.agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))


@operation("SRC-5 SRC-8", sql="""
SELECT text || chr(10) AS text, regexp_matches(text, '\\S') AS ok FROM documents""")
def decoded_files(spark: SparkSession, sf: str) -> DataFrame:
    """Text and success flag of every document file."""
    read = files.read_files(files.find_files(spark, _document_folder(spark, sf), with_content=True))
    return read.select("text", "ok")


@operation("SRC-5", sql="SELECT doc_id, text AS utf8, text AS latin1 FROM documents")
def decoded_encodings(spark: SparkSession, sf: str) -> DataFrame:
    """Texts decoded from UTF-8 bytes, and from Latin-1 bytes where those are not valid UTF-8."""
    docs = table(spark, sf, "documents")
    latin = F.encode("text", "ISO-8859-1")
    fits = F.decode(latin, "ISO-8859-1") == F.col("text")
    invalid = ~F.is_valid_utf8(latin.cast("string"))
    return docs.select("doc_id", files.decode(F.encode("text", "UTF-8")).alias("utf8"),
                       F.when(fits & invalid, files.decode(latin)).otherwise(F.col("text")).alias("latin1"))


@operation("SRC-6", uses=["feed_v1"], sql="""
SELECT id || '  ' || name || '  ' || size || '  ' || kind AS line FROM feed_v1""")
def csv_as_text(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a CSV file as searchable lines."""
    return csv.rows_as_text(csv.read_text_table(spark, _written_csv(spark, sf, "feed_v1")))


@operation("SRC-7", uses=["payloads"], sql="""
SELECT event_id, CASE WHEN json_valid(body) THEN CAST(json(body) AS varchar) END AS json_text FROM payloads""")
def json_text(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads written again as JSON; null where they do not parse."""
    return fixture(spark, sf, "payloads").select("event_id", files.json_text(F.col("body")).alias("json_text"))


@operation("SRC-9 TXT-2", sql="""
WITH c AS (SELECT text || chr(10) AS t, greatest(length(text) + 1 - 200, 1) AS last_start FROM documents),
s AS (SELECT substr(t, start, 2000) AS chunk FROM (SELECT t, unnest(range(1, last_start + 1, 1800)) AS start FROM c))
SELECT count(*) AS n_passages, CAST(sum(length(chunk)) AS BIGINT) AS n_chars FROM s WHERE regexp_matches(chunk, '\\S')""")
def ingested_files(spark: SparkSession, sf: str) -> DataFrame:
    """Passages made from all document files in character chunks."""
    passages = files.ingest_files(spark, _document_folder(spark, sf))
    return passages.agg(F.count(F.lit(1)).alias("n_passages"), F.sum(F.length("text")).alias("n_chars"))


@operation("SRC-9", sql="""
SELECT count(*) AS total_files, count(*) FILTER (WHERE regexp_matches(text, '\\S')) AS ingested,
  count(*) FILTER (WHERE NOT regexp_matches(text, '\\S')) AS failed FROM documents""")
def ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Document files read and failed."""
    return files.ingest_counts(files.read_files(files.find_files(spark, _document_folder(spark, sf), with_content=True)))


@operation("SRC-10 TXT-1", sql="""
WITH w AS (SELECT len([x for x in regexp_split_to_array(text, '\\s+') if x <> '']) AS n FROM documents)
SELECT CAST(ceil(n / 448.0) AS BIGINT) AS n_chunks, count(*) AS n_files FROM w WHERE n > 0 GROUP BY 1""")
def folder_chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many document files give how many word chunks."""
    passages = files.ingest_folder(spark, _document_folder(spark, sf), "*.txt")
    return files.chunks_per_source(passages).groupBy("n_chunks").agg(F.count(F.lit(1)).alias("n_files"))


@operation("SRC-11", uses=["usage_log"], sql="""
SELECT model, count(*) AS calls FROM usage_log GROUP BY model""")
def state_file(spark: SparkSession, sf: str) -> DataFrame:
    """Usage state written as JSON and read back, together with an absent state file."""
    path, schema = work_path(spark, "usage-state"), "model string, calls bigint"
    state.write_run(fixture(spark, sf, "usage_log").groupBy("model").agg(F.count(F.lit(1)).alias("calls")), path)
    kept = spark.read.schema(schema).json(path)
    return kept.unionByName(state.read_or_empty(spark, work_path(spark, "absent"), schema))


@operation("SRC-12", uses=["payloads"], sql="""
SELECT event_id, CAST(body ->> '$.k' AS BIGINT) AS k FROM payloads WHERE body LIKE '{"%'
UNION ALL SELECT event_id, NULL FROM payloads WHERE body NOT LIKE '{"%'""")
def json_cells(spark: SparkSession, sf: str) -> DataFrame:
    """JSON in CSV cells parsed into columns."""
    exported = csv.read_text_table(spark, _written_csv(spark, sf, "payloads"))
    parsed = csv.json_cells(exported, body="struct<k: bigint>")
    return parsed.select(F.col("event_id").cast("bigint").alias("event_id"), "body.k")


@operation("SNK-2", uses=["dirty_items"], sql=q.repaired_items("dirty_items")
           + "SELECT 'clean' AS part, count(*) AS n_rows FROM clean_items")
def written_clean_table(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the repaired items as written; nothing is quarantined, so no second table appears."""
    repaired = single_table.repair(single_table.stage(fixture(spark, sf, "dirty_items"))).table
    clean, bad = csv.write_repair(repaired, repaired.limit(0), work_path(spark, "out"), "items")
    parts = [("clean", clean)] + ([("quarantined", bad)] if bad else [])
    rows = [(part, spark.read.parquet(path).count()) for part, path in parts]
    return spark.createDataFrame(rows, "part string, n_rows bigint")


@operation("SNK-3", sql="""
WITH w AS (SELECT source, [x for x in regexp_split_to_array(text, '\\s+') if x <> ''] AS ws FROM documents),
c AS (SELECT source, start // 448 + 1 AS chunk_no, array_to_string(ws[start + 1 : start + 512], ' ') AS chunk FROM
  (SELECT source, ws, unnest(range(0, len(ws), 448)) AS start FROM w))
SELECT source, count(*) AS n_passages FROM (SELECT DISTINCT source, chunk_no, chunk FROM c) GROUP BY source""")
def appended_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Passages per source after appending the same documents twice."""
    store = work_path(spark, "passages")
    chunks = ck.explode_chunks(table(spark, sf, "documents"), ck.word_chunks(F.col("text")), "source")
    for _ in range(2):
        files.append_passages(files.as_passages(chunks), store)
    return files.read_passages(spark, store).groupBy("source").agg(F.count(F.lit(1)).alias("n_passages"))


@operation("SNK-5", uses=["eval_scores"], sql="""
SELECT metric, round(avg(score), 6) AS mean FROM eval_scores GROUP BY metric""")
def written_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Metric means of an evaluation run after writing it as JSON."""
    from ..operators.accounting import metric_means

    path = work_path(spark, "evaluation")
    state.write_run(metric_means(fixture(spark, sf, "eval_scores")), path)
    return spark.read.schema("metric string, mean double").json(path).withColumn("mean", F.round("mean", 6))
