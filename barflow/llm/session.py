"""Checkpoints in the folder that the session names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barflow.sources.session import shared_folder

__all__ = ["bounded", "checkpointed", "fresh", "shared_folder"]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` for one side of a join: it is broadcast if it has at most so many rows, and shuffled like any table beyond."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= most else df


def fresh(columns: list[str], *names: str) -> list[str]:
    """A name for each of ``names`` that none of the ``columns`` has, whatever its case: underscores are added until it is free."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
