"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Bytes of one Arrow batch while a table is stored: rows are as long as texts, and thousands of them would be hundreds of megabytes.
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20
#: Folders of the tables stored and not dropped.
MADE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where a local session has none, a temporary one, and an error on a cluster."""
    found = spark.conf.get(KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{KEY} has to name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="shelfspark-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs neither recompute nor depend on one executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    usual = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, str(BATCH))
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(BATCH_KEY, usual)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    MADE.add(path)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` once nothing reads them any more."""
    for df in tables:
        delete(df.sparkSession, df.stored_path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    MADE.discard(folder)


def sweep(spark: SparkSession) -> int:
    """Delete all tables that this process has stored and not dropped; for when the results of its queries are used up."""
    folders = sorted(MADE)
    for folder in folders:
        delete(spark, folder)
    return len(folders)
