"""The files between a pipeline's stages: one folder a stage, one below it a symbol, and the columns that each must have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns that a stage's rows have at least.
COLUMNS = {"validated": ["symbol", "ts", "open", "high", "low", "close", "volume"], "cleaned": ["symbol", "timestamp", "open", "high", "low", "close", "volume"], "features": ["symbol", "session_date", "ready"]}


def _checked(df: DataFrame, stage: str) -> DataFrame:
    if missing := sorted(set(COLUMNS[stage]) - set(df.columns)):
        raise ValueError(f"rows of {stage} lack {missing}")
    return df


def write_stage(df: DataFrame, path: str, stage: str) -> None:
    """The stage's rows in place of those before, so that a run that is repeated leaves one copy. Filters on symbol later read its
    folder alone."""
    _checked(df, stage).write.mode("overwrite").partitionBy("symbol").parquet(f"{path}/{stage}")


def read_stage(spark: SparkSession, path: str, stage: str) -> DataFrame:
    return _checked(spark.read.parquet(f"{path}/{stage}"), stage)
