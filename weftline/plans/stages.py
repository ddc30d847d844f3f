"""Staged tables: cutting lineage so that a lost executor costs one stage, not the job.

A staged table is a Parquet table in the folder that the cluster names in
``spark.checkpoint.dir``. Unlike cached or locally checkpointed blocks it
survives the loss of executors, it is compressed, and later readers prune its
columns.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Spark deletes the shuffle files of a query when it ends.
_CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ADAPTS = "spark.sql.adaptive.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set (tests), a new local one."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
    return context.getCheckpointDir().rstrip("/")


class Stages:
    """Writes tables for one run and deletes those that are no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/weftline-{uuid.uuid4().hex}"
        self._count = 0

    def write(self, df: DataFrame, adaptive: bool = True) -> DataFrame:
        """``df`` written out and read again; shuffles on the way leave no files. Not ``adaptive``: planned once, for many small stages."""
        self._count += 1
        path = f"{self.folder}/{self._count}"
        settings = {_CLEANS: "true"} | ({} if adaptive else {_ADAPTS: "false"})
        before = {k: self.spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weftline_stage = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes staged tables; nothing that is still lazy may read them."""
        jvm = self.spark._jvm
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(frame._weftline_stage)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def clear(spark: SparkSession, older_than_hours: float = 24.0) -> int:
    """Deletes the folders of runs that were last written to so long ago; returns how many.

    Results are lazy and may read a run's tables until they are written, so a
    cluster calls this for runs that are over.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    before, gone = (time.time() - older_than_hours * 3600) * 1000, 0
    for status in files.listStatus(path):
        if status.getPath().getName().startswith("weftline-") and status.getModificationTime() <= before:
            files.delete(status.getPath(), True)
            gone += 1
    return gone
