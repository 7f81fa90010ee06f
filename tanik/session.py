"""Session helpers shared by the jobs."""

from __future__ import annotations

import re
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``, read by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that all executors share: ``spark.checkpoint.dir``.

    Where that setting is missing, a session on one machine, as in tests, gets a folder of its own; on a
    cluster it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage by ``checkpoint()`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """``saved`` for rounds that join their own results: Spark knows the result by its measured size.

    A checkpoint carries on the size that Spark estimated for it, and an equi-join is estimated as the
    product of its sides, so rounds of self-joins square that number again and again until its digits
    alone fill the driver. Rows that lie in the cache for the time of the checkpoint have been measured.
    """
    shared_folder(df.sparkSession)
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        kept.count()
        return kept.checkpoint(eager=True)
    finally:
        kept.unpersist()
