"""Tables of a directory of Parquet files, and where a job may put what it writes between stages."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in local mode alone, a folder of this machine where it is unset."""
    given = spark.conf.get("spark.checkpoint.dir", "") or ""
    if given:
        return given
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(shared_folder, "own", None):
        shared_folder.own = tempfile.mkdtemp(prefix="cloakframe-")
        atexit.register(shutil.rmtree, shared_folder.own, ignore_errors=True)
    return shared_folder.own


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: lineage ends there and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def sweep(spark: SparkSession | None = None) -> int:
    """Delete what settle() wrote in this process, once no table that came of it is needed; returns how many tables.

    Results are lazy, so this cannot happen when a query returns; it runs when
    the process ends, or earlier where a long-lived one calls it.
    """
    jvm = spark.sparkContext._jvm if spark is not None else SparkContext._jvm
    done = len(_written)
    while _written and jvm is not None:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    return done


@atexit.register
def _at_the_end() -> None:
    try:
        sweep()
    except Exception:  # noqa: BLE001 - the JVM may be gone before this process
        pass
