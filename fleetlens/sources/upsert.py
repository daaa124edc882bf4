"""Writes that depend on what is stored already, as new versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_write(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key. An aggregate: copies of one key meet on the
    map side and never gather in a window."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """IO8: incoming rows replace stored rows of the same key, the last one wins."""
    fresh = last_write(incoming, keys, order)
    return stored.join(fresh, keys, "left_anti").unionByName(fresh.select(*stored.columns))


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """IO9: incoming rows whose key is not stored yet."""
    return incoming.join(stored.select(*keys), keys, "left_anti")


def replace_groups(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """IO10: all stored rows of an incoming key go, the incoming rows come."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def keep_configured(stored: DataFrame, configured: DataFrame, key: str) -> DataFrame:
    """IO11: rows whose key is still configured."""
    return stored.join(configured.select(key), key, "left_semi")


def raw_payloads(df: DataFrame, key: str) -> DataFrame:
    """IO12: (raw_ref, key, payload); the same row always gets the same ref."""
    payload = F.to_json(F.struct(*[c for c in df.columns]))
    return df.select(F.substring(F.sha2(payload, 256), 1, 32).alias("raw_ref"), key, payload.alias("payload"))
