"""Cutting a long plan where a result feeds several later branches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_settled: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    A session inside one process (``local[...]``) gets a fresh folder of its own when none is
    named; on a cluster such a folder would be seen by one machine only, so this raises.
    """
    folder = spark.conf.get(SETTING, None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            folder = tempfile.mkdtemp(prefix="netloom-")
        else:
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        spark.conf.set(SETTING, folder)
    return folder


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Later branches then read only their columns instead of repeating the plan, and a lost
    executor costs a re-read, not a recomputation of everything before.  What the plan had shuffled is
    deleted as soon as the table is written, so the disk never holds the shuffles of two steps.  :func:`release`
    deletes the tables when the results that read them are no longer needed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _settled.setdefault(spark.sparkContext.applicationId, []).append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete every table this application has settled; returns their number.

    Call it when the results have been written: a frame that still reads a settled table
    fails afterwards.
    """
    paths = _settled.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)
