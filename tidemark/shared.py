"""Tables in the folder that all executors share: they cut the lineage of iterative jobs and outlive a lost executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """path as a URI: one without a scheme belongs to the cluster's default file system, as it does for Spark's own readers."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the cluster's spark.checkpoint.dir; where that is unset, a local master (as in tests) gets one in /tmp, any other an error.

    On a master that is not local, a folder of one machine (`file:`) is taken at its word: it must be a mount that all executors have."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = "/tmp/tidemark-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{qualified(spark, base).rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as a table in the shared folder."""
    path = folder or shared_folder(df.sparkSession)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, folder: str) -> bool:
    """Deletes a folder that `shared_folder` named, with what is in it; nothing that reads it may run later. Tells whether it was there."""
    if not folder.rstrip("/").rpartition("/")[2].startswith("tidemark-"):
        raise ValueError(f"{folder} is no folder of this library")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
