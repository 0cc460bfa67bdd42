"""Stage tables: results that several later stages read are written once to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that all machines share, spark.checkpoint.dir; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


#: Whether the shuffle files that led to a written table go once it is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the rows to the shared folder and reads them: a lost executor costs no recomputation of what led to them.

    The shuffle files that led to them are of no use any more and go at once. path: a new one, unless told.
    """
    spark, path = df.sparkSession, path or shared_folder(df.sparkSession)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*stages: DataFrame) -> None:
    """Deletes the files of stage tables that nothing reads any more."""
    for df in stages:
        jvm = df.sparkSession._jvm
        for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
