"""Session helpers: lineage cuts that every executor can read again."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only on a local master where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame, dealt: bool = False) -> DataFrame:
    """``df`` computed once and kept in the shared folder; survives lost executors.

    With ``dealt`` it is planned without adaptive execution, so that Spark knows how its
    last shuffle dealt the rows and can join on the same key without shuffling them anew.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if not dealt:
        return df.checkpoint()
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(name, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table, in whatever store its path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished phases that nothing refers to any more.

    Two collections: the first frees plans, the second the shuffles that they held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)
