"""Reading the driver's tables, and time arithmetic that doesn't depend on the session's zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    name = ts if isinstance(ts, str) else None
    if name is None:
        raise TypeError("a column name is wanted")
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")
