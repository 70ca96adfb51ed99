"""Settings that jobs read from the session."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session without spark.checkpoint.dir gets a folder of its own."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to that folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows up to which a checkpointed table of a row a key, or a key of a range, is sent to all tasks.
FEW = 20_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A checkpointed ``df``, broadcast if it has up to ``most`` rows. What is joined with it then stays where it is, so that a key with many rows
    is as many tasks as before. Left to itself, Spark does not broadcast a few keys that a shuffle dealt over many partitions."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
