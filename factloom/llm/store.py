"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_made: list[str] = []  # folders of the tables that were written and not deleted


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset and all runs on this machine (tests) a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted when the driver ends, or by forget or settled before."""
    folder = f"{shared_folder(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    _made.append(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _made.remove(folder)
    # shuffle files that nothing refers to any more go with the driver's garbage
    spark._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing needs any more."""
    for df in tables:
        files = df.inputFiles()
        _delete(df.sparkSession, [f for f in _made if any(f"/{f.rpartition('/')[2]}/" in x for x in files[:1])])


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns, as a written table; all other tables that were written for it are deleted."""
    before = set(_made)
    out = written(make(), name)
    kept = _made[-1]
    _delete(spark, [f for f in _made if f not in before and f != kept])
    return out


def rows_with(df: DataFrame, keys: DataFrame, on: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of df whose `on` is in keys (distinct longs): keys are broadcast up to broadcast_rows, else both sides are shuffled."""
    small = keys.limit(broadcast_rows + 1).count() <= broadcast_rows
    return df.join(F.broadcast(keys) if small else keys.hint("merge"), on, "left_semi")


def small(table: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """A written table with a row per source or the like, marked for broadcast if its rows are few, else for a merge join."""
    return F.broadcast(table) if table.limit(broadcast_rows + 1).count() <= broadcast_rows else table.hint("merge")
