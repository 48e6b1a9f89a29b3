"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset on one machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="relgen-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, survives lost executors.

    The files go when the session's JVM ends, or with ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/relgen-{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    fs, at = filesystem(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def together(parts: list[DataFrame]) -> DataFrame:
    """Steps that ``written`` gave, of one schema, as one scan however many they are."""
    if len(parts) == 1:
        return parts[0]
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*(p._written_at for p in parts))


def dropped(df: DataFrame) -> None:
    """Deletes the files of a step that ``written`` gave, once nothing will read it again."""
    fs, at = filesystem(df.sparkSession, df._written_at)
    fs.delete(at, True)


def filesystem(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
