"""Folders that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set (tests on one machine) one of our own, which goes at exit.

    A cluster without that setting is refused: its executors would not see the driver's folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="partlens-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/partlens/{tag}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to shared storage and read it again: the lineage is cut, lost executors cost nothing."""
    path = fresh_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that were written between stages, of this and of earlier sessions; results that are still to be read are lost."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/partlens")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
