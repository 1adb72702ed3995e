"""A shared folder for tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``; it goes when the JVM ends.

    Where that is unset a local folder serves, if all runs on this machine; a cluster's
    executors could not see one another's.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="heddle-")
    path = f"{folder.rstrip('/')}/heddle-{name}-{uuid.uuid4().hex}"
    fs, hadoop = _fs(spark, path)
    fs.deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _fs(spark, path)
    return fs.exists(hadoop)


def made(spark: SparkSession, path: str) -> str:
    """The path, now a folder."""
    fs, hadoop = _fs(spark, path)
    fs.mkdirs(hadoop)
    return path


def removed(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _fs(spark, path)
    return fs.delete(hadoop, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below the path."""
    fs, hadoop = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(hadoop) if f.isDirectory()]
