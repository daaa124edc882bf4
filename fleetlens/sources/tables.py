"""Readers that shape stored tables for the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_PREVIEW = 1000
HIDDEN_COLUMNS = ["embedding"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """IO1"""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def since(df: DataFrame, column: str, start: str, end: str | None = None) -> DataFrame:
    """PF17/PF2: a read of a big time series must name its lower bound. The
    bound is compared with the stored column itself, so it reaches the scan."""
    if not start:
        raise ValueError(f"a lower bound on {column} is required")
    kind = dict(df.dtypes)[column]
    df = df.where(F.col(column) >= F.lit(start).cast(kind))
    return df if end is None else df.where(F.col(column) < F.lit(end).cast(kind))


def days_before(as_of: str, days: int) -> str:
    """PF14: the bound `days` before a pinned day."""
    import datetime

    return (datetime.date.fromisoformat(as_of) - datetime.timedelta(days=days)).isoformat()


def published(df: DataFrame, hidden: list[str] = HIDDEN_COLUMNS) -> DataFrame:
    """PF12: the table without the columns that are never shown."""
    return df.drop(*hidden)


def bounded_preview(df: DataFrame, order: list[Column], n: int = 100) -> DataFrame:
    """TK2: at most `n` rows, never more than 1000."""
    return df.orderBy(*order).limit(min(n, MAX_PREVIEW))


def reference_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """IO14: a fixed list of settings as a table, small by construction."""
    return F.broadcast(spark.createDataFrame(rows, schema))
