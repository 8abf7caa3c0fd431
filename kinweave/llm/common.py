"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.session import stage

__all__ = ["read", "short_batches", "stage"]

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def short_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, whose session hands at most so many rows at once to Python: whole texts may be long.

    A smaller setting of the session stays. Spark reads it where a job is planned, so it is kept on.
    """
    if int(df.sparkSession.conf.get(_BATCH_ROWS)) > rows:
        df.sparkSession.conf.set(_BATCH_ROWS, str(rows))
    return df
