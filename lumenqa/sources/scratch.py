"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback_root: list[str] = []
_written: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors and the driver share.

    It is the cluster's ``spark.checkpoint.dir``; only where that is unset and the master is one
    machine (tests) a temporary folder is made.  On a cluster the setting is needed.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _fallback_root:
        _fallback_root.append(tempfile.mkdtemp(prefix="lumenqa-scratch-"))
    return f"file://{_fallback_root[0]}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, remembered under ``label`` for :func:`release`."""
    path = f"{shared_root(spark)}/lumenqa/{re.sub(r'[^A-Za-z0-9]+', '-', label)[-60:]}-{uuid.uuid4().hex}"
    _written.setdefault(label, []).append(path)
    return path


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts lineage like a reliable checkpoint: a lost executor costs a re-read, not a
    recomputation, and a value such as a generated row id is fixed from here on.  The table lasts
    until :func:`release` or the end of the driver.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    at, files = _hadoop(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(spark: SparkSession, label: str) -> None:
    """Deletes the scratch tables of ``label``; call it when what reads them has been written."""
    for path in _written.pop(label, []):
        at, files = _hadoop(spark, path)
        files.delete(at, True)


#: Files of a table up to so many bytes can be few row groups, each of which one task reads.
SMALL_TABLE = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of files; a small one in fewer files than there are cores is dealt to all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL_TABLE and len(df.inputFiles()) < cores else df
