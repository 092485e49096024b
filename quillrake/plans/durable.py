"""Durable cuts of a plan: tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    """Used only where the session names no shared folder, as in tests on one machine."""
    path = tempfile.mkdtemp(prefix="quillrake-")
    atexit.register(shutil.rmtree, path, True)
    return f"file://{path}"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or _own_folder()).rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/quillrake/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it again: (the table, its path).

    It ends the lineage, survives the loss of any executor, and forgets the partitioning, so a later join shuffles
    both sides and adaptive execution can split its hot keys.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
