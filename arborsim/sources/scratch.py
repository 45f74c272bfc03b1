"""Space in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset and all is one process, a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="arborsim-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def path(spark: SparkSession, what: str) -> str:
    """A new path there, deleted when the session's JVM ends."""
    new = f"{shared_dir(spark)}/arborsim/{what}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return new


def local(spark: SparkSession, at: str) -> str:
    """The path as other programs see it; an error if it isn't in a file system that is mounted here."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() != "file":
        raise ValueError(f"not a mounted file system: {at}")
    return p.toUri().getPath()


def materialise(df: DataFrame, what: str) -> DataFrame:
    """df, written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    at = path(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
