"""Cutting lineage through the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_fallback: list[tempfile.TemporaryDirectory] = []
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset and everything runs in this machine's own process, a temporary one."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _fallback:
        _fallback.append(tempfile.TemporaryDirectory(prefix="latticework-"))
    return f"file://{_fallback[0].name}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None, *, clean: bool = True) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a reader of it.

    A lost executor then costs its running tasks only: what was written stays.
    The folder is removed by ``discard``, or when the driver's interpreter ends. The shuffle files
    behind ``df`` are of no use any more: a collection on the driver lets Spark's cleaner remove them,
    unless ``clean`` is false (small tables in a loop).
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    if clean:
        spark.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what ``materialize`` wrote and returned as ``tables``; call it once nothing reads them any more."""
    for df in tables:
        if path := _places.pop(df, None):
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:
        return
    try:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session is going down, or the folder has gone already
        return
