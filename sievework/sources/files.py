"""Folders of documents: finding files, reading their text, ingesting passages."""

from __future__ import annotations

import math
import os
import re
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payload import is_json
from ..operators import chunking as ck
from ..session import local_path, materialize, spread
from .state import read_or_empty

# --- fixed values: what counts as a document -------------------------------------------------------
EXTENSIONS = [".pdf", ".docx", ".txt", ".md", ".csv", ".json"]
EXCLUDED_FOLDERS = [".git", "__pycache__", ".venv", "node_modules", ".pytest_cache"]
UNREAD_EXTENSIONS = [".pdf", ".docx"]
# -----------------------------------------------------------------------------------------------------

FILES_PER_FOLDER = 1_000  # folders are listed by tasks, so none should hold much more than the others
LISTED_ROWS = 10_000  # entries of folders that a task hands on at a time
READ_BYTES = 4 << 20  # contents that a task hands on at a time, at least a file
TASK_FILES, TASK_BYTES = 20_000, 64 << 20  # files that one task reads


def suffix(path: Column) -> Column:
    """Lower-case extension of a path with its point; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def write_texts(df: DataFrame, column: str, folder: str) -> str:
    """A text file for every row of a plain scan below a folder: the text and a line feed, the line feed alone where it is null.

    Tasks write their rows into subfolders of bounded size; no two files share a name.  The files of a subfolder appear together once they
    are complete, and a task that runs again writes the same names.  On a local or mounted folder the files are written
    without checksum files and without a process per file that sets permissions; any other store takes Spark's writer.
    """
    texts = spread(df.select(F.col(column).alias("text")))
    root = local_path(df.sparkSession, folder)
    if root is None:
        texts.write.options(maxRecordsPerFile=1, **{"mapreduce.fileoutputcommitter.algorithm.version": "2"}).text(folder)
        return folder

    def publish(unfinished: str, complete: str) -> None:
        try:
            os.rename(unfinished, complete)
        except OSError:          # an earlier run of the task was there first
            for name in os.listdir(unfinished):
                os.replace(f"{unfinished}/{name}", f"{complete}/{name}")
            os.rmdir(unfinished)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, unfinished = TaskContext.get(), 0, ""
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                if n % FILES_PER_FOLDER == 0:
                    if n:
                        publish(unfinished, complete)
                    below = f"{task.partitionId():05d}-{n // FILES_PER_FOLDER:05d}"
                    unfinished, complete = f"{root}/.{below}.{task.taskAttemptId()}", f"{root}/{below}"
                    os.mkdir(unfinished)
                with open(f"{unfinished}/{task.partitionId():05d}-{n:09d}.txt", "wb", buffering=0) as out:
                    out.write((text or b"") + b"\n")
                n += 1
        if n:
            publish(unfinished, complete)
        yield pa.RecordBatch.from_pydict({"n": [n]}, pa.schema([("n", pa.int64())]))

    os.makedirs(root, exist_ok=True)
    texts.mapInArrow(write, "n long").agg(F.sum("n")).first()
    return folder


def _ignored(name: str, is_folder: bool) -> bool:
    """Names that Spark's file readers leave out."""
    if is_folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name


def _entries(folder: str, exclude: list[str]) -> Iterator[tuple[str, int, bool]]:
    """(path, length, is_folder) of what a folder holds; empty files are left out, as Spark's readers do."""
    with os.scandir(folder) as entries:
        for entry in entries:
            try:
                found = entry.stat()
                entry.name.encode()
            except (FileNotFoundError, UnicodeEncodeError):          # a link that leads nowhere, a file that is gone, a name that is no text
                continue
            is_folder = stat.S_ISDIR(found.st_mode)
            if not _ignored(entry.name, is_folder) and entry.name not in exclude and (is_folder or found.st_size):
                yield entry.path, found.st_size, is_folder


def _listed_by_tasks(spark: SparkSession, root: str, exclude: list[str]) -> DataFrame:
    """(path, length) of all files below a local folder.

    Folders are listed by tasks, one level of them after the other, and the entries are written to the shared folder:
    the driver sees neither files nor folders.
    """
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("is_folder", pa.bool_())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                for row in _entries(folder, exclude):
                    rows.append(row)
                    if len(rows) == LISTED_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    tasks = 4 * spark.sparkContext.defaultParallelism
    folders, n, found = spark.createDataFrame([(root,)], "path string"), 1, None
    while n:
        level = materialize(folders.repartition(min(n, tasks)).mapInArrow(listed, "path string, length long, is_folder boolean"), "listing")
        found = level if found is None else found.unionByName(level)
        folders = level.where("is_folder").select("path")
        n = folders.count()
    return found.where("NOT is_folder").select(F.concat(F.lit("file:"), F.col("path")).alias("path"), "length")


def _with_content(listed: DataFrame) -> DataFrame:
    """Listed local files with their content, dealt over tasks by number and size."""
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                with open(path.removeprefix("file:"), "rb", buffering=0) as file:
                    content = file.readall()
                rows.append((path, length, content))
                size += len(content)
                if size >= READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    n, size = listed.agg(F.count(F.lit(1)), F.sum("length")).first()
    tasks = max(listed.sparkSession.sparkContext.defaultParallelism, math.ceil(n / TASK_FILES), math.ceil((size or 0) / TASK_BYTES))
    return listed.repartition(tasks).mapInArrow(read, "path string, length long, content binary")


def _files(spark: SparkSession, folder: str, recursive: bool = True, exclude: list[str] | None = None,
           pattern: str | None = None) -> tuple[DataFrame, bool]:
    """Files below a folder, and whether they are only listed: (path, length), else (path, length, content) and more.

    A local or mounted folder is listed by tasks.  Spark's reader keeps a record of every file in the driver; it is left the
    other stores, folders without those below them, and paths that are no folder or hold wildcards.
    """
    root = local_path(spark, folder)
    if root is not None and recursive and os.path.isdir(root) and not re.search(r"[*?\[\]{}\\]", root):
        listed = _listed_by_tasks(spark, root, exclude or [])
        if pattern:
            named = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
            listed = listed.where(file_name(F.col("path")).rlike(f"(?s)^(?:{named})\\z"))
        return listed, True
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder), False


def find_files(spark: SparkSession, folder: str, recursive: bool = True, extensions: list[str] | None = None,
               exclude: list[str] | None = None, with_content: bool = False) -> DataFrame:
    """(path, length[, content]) of the documents below a folder.

    Without the content only the listing is read, and it comes in path order; contents are not sorted.
    """
    exclude = exclude or EXCLUDED_FOLDERS
    files, only_listed = _files(spark, folder, recursive, exclude)
    parts = F.split("path", "/")
    skipped = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in exclude]))
    kept = files.where(suffix(F.col("path")).isin(extensions or EXTENSIONS) & ~skipped)
    if not with_content:
        return kept.select("path", "length").orderBy("path")
    return _with_content(kept) if only_listed else kept.select("path", "length", "content")


def decode(content: Column) -> Column:
    """UTF-8 where the bytes are valid UTF-8, else Latin-1, which accepts any bytes."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(
        F.decode(content, "ISO-8859-1"))


def tolerant_utf8(content: Column) -> Column:
    """UTF-8 text without the bytes that are not valid; the replacement character goes with them."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def json_text(text: Column) -> Column:
    """JSON text written again; null when it does not parse."""
    return F.when(is_json(text), F.to_json(F.try_parse_json(text)))


def read_files(files: DataFrame) -> DataFrame:
    """(path, name, text, ok) of found files with their content, by extension.

    JSON is parsed and written again; every other readable kind is its decoded text, CSV included.
    """
    kind = suffix(F.col("path"))
    decoded = files.select("path", kind.alias("kind"), decode(F.col("content")).alias("decoded"))
    text = (F.when(F.col("kind").isin(UNREAD_EXTENSIONS), F.lit(None).cast("string"))
            .when(F.col("kind") == ".json", json_text(F.col("decoded"))).otherwise(F.col("decoded")))
    read = decoded.select("path", file_name(F.col("path")).alias("name"), text.alias("text"))
    return read.withColumn("ok", F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False)))


def ingest_files(spark: SparkSession, folder: str, recursive: bool = True, max_files: int | None = None,
                 exclude: list[str] | None = None) -> DataFrame:
    """Passages (id, text, source) of the readable documents below a folder, in character chunks.

    Sources read ``name (chunk i/n)``.  ``max_files`` keeps the first files in path order.
    """
    listed = find_files(spark, folder, recursive, exclude=exclude, with_content=True)
    if max_files:
        first = find_files(spark, folder, recursive, exclude=exclude).select("path").limit(max_files)
        listed = listed.join(first, "path", "left_semi")
    texts = read_files(listed).where("ok")
    chunks = ck.explode_chunks(texts, ck.char_chunks(F.col("text")), "name").where(F.col("chunk").rlike(r"(?U)\S"))
    source = F.format_string("%s (chunk %d/%d)", "name", "chunk_no", "n_chunks")
    return as_passages(chunks.select("chunk", source.alias("source"), "chunk_no"))


def ingest_counts(files: DataFrame) -> DataFrame:
    """(total_files, ingested, failed) of read files."""
    return files.agg(F.count(F.lit(1)).alias("total_files"), F.count_if("ok").alias("ingested"),
                     F.count_if(~F.col("ok")).alias("failed"))


def ingest_folder(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """Passages of all text files matching a pattern, in word chunks; sources are the file names.

    Bytes that are not UTF-8 are dropped, so one bad file does not fail the folder.
    """
    files, only_listed = _files(spark, folder, pattern=pattern)
    files = _with_content(files) if only_listed else files
    texts = files.select(file_name(F.col("path")).alias("source"), tolerant_utf8(F.col("content")).alias("text"))
    chunks = ck.explode_chunks(texts, ck.word_chunks(F.col("text")), "source")
    return as_passages(chunks)


def as_passages(chunks: DataFrame) -> DataFrame:
    """(id, text, source) with content-derived ids."""
    return chunks.select(ck.passage_id(F.col("source"), F.col("chunk_no"), F.col("chunk")).alias("id"),
                         F.col("chunk").alias("text"), F.coalesce("source", F.lit("unknown")).alias("source"))


def chunks_per_source(passages: DataFrame) -> DataFrame:
    return passages.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"))


def append_passages(passages: DataFrame, path: str) -> None:
    """Append passages that the store does not hold yet; running an ingest again adds nothing."""
    spark = passages.sparkSession
    fresh = passages.dropDuplicates(["id"])
    store = read_passages(spark, path)
    fresh.join(store.select("id"), "id", "left_anti").write.mode("append").parquet(path)


PASSAGE_SCHEMA = "id string, text string, source string"


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """The passage store; empty when nothing was written yet."""
    return read_or_empty(spark, path, PASSAGE_SCHEMA, "parquet")


def list_passages(passages: DataFrame, limit: int = 1000) -> DataFrame:
    """The first passages by id."""
    return passages.select("id", "text", F.coalesce("source", F.lit("unknown")).alias("source")).orderBy("id").limit(limit)
