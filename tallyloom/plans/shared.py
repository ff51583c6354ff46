"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a join's smaller side up to which it goes to every task.
FEW = 100_000


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; in a local session without one, a fresh temporary folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialised in the shared folder; a recursion's plan would grow with each round otherwise."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, cut=cut) -> DataFrame:
    """Materialised; with few rows it goes to every task of a join, and the other side stays where it lies. Else a join shuffles both."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= FEW else df
