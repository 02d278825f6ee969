"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Runtime settings every job relies on.  Anything the cluster sets itself (executor sizes,
# shuffle partitions, broadcast threshold) is left alone.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where the rows are aggregated by that key right after
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # ten thousand long texts at a time would fill both the JVM's buffers and the Python workers
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def build_session(app_name: str = "sievework", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or fetch) a session with the settings the library expects."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets a temporary folder of its own,
    remembered in the session so that later calls agree on it.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="sievework-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def local_path(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder on a local or mounted file system; None in any other store."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", folder)
    store = scheme[1] if scheme else spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").split(":")[0]
    return os.path.abspath(re.sub(r"^file:(//[^/]*)?", "", folder, flags=re.IGNORECASE)) if store.lower() == "file" else None


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/sievework/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan over all cores where its files give fewer tasks than that.

    A few large row groups would otherwise keep most cores idle for every later pass.  A table of
    many files is left as it is.  Meant for plain scans and projections of them.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later passes start from files that outlive any executor, read only the columns they use, and
    do not repeat the shuffles that produced the rows.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
