"""Stored tables that change in place: rows lie in hash buckets of their key, and a change rewrites only the buckets it touches.

A version is a manifest: for each bucket the folder that holds it. A change writes new folders for the touched buckets, then a
manifest that names them and, for all other buckets, the folders of the version before. A reader sees one manifest, so it sees the table
before or after a change, never between; folders of a write that failed are named by no manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.sources import upsert

MANIFEST = "bucket int, folder string, version long"
#: The manifest row that describes the table.
ABOUT = -1


class Stored:
    """One version of a stored table. Changes return the next one."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        manifests = spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        if version is None:
            version = manifests.agg(F.max("version")).first()[0]
        # As many rows as buckets.
        rows = manifests.where(F.col("version") == version).collect()
        self.version = version
        self.folders = {r["bucket"]: r["folder"] for r in rows if r["bucket"] != ABOUT}
        about = json.loads(next(r["folder"] for r in rows if r["bucket"] == ABOUT))
        self.keys, self.buckets, self.properties = about["keys"], about["buckets"], about["properties"]
        self.schema = T.StructType.fromJson(about["schema"])

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: list[str], buckets: int = 64, properties: dict | None = None) -> Stored:
        """Writes `df` as the first version. Rows with equal keys share a bucket; take so many buckets that one is a file of good size."""
        self = cls.__new__(cls)
        self.spark, self.path, self.version, self.folders = df.sparkSession, path.rstrip("/"), -1, {}
        self.keys, self.buckets, self.schema, self.properties = keys, buckets, df.schema, properties or {}
        return self._next(df, set(range(buckets)), self.properties)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """The rows, of some buckets or of all: only their files are read."""
        folders = [f"{self.path}/{f}" for b, f in sorted(self.folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def touched(self, changes: DataFrame) -> set[int]:
        """The buckets of some keys; at most as many as the table has."""
        return {r[0] for r in changes.select(self.bucket()).distinct().collect()}

    def _next(self, rows: DataFrame, buckets: set[int], properties: dict) -> Stored:
        """The version in which `buckets` hold `rows` and all others what they hold now."""
        version, folder = self.version + 1, f"data/{uuid.uuid4().hex}"
        rows.select(*[f"`{f.name}`" for f in self.schema]).withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        # Partition values come from folder names.
        held = {r[0] for r in self.spark.read.schema("_bucket int").parquet(f"{self.path}/{folder}").select("_bucket").distinct().collect()}
        folders = {b: f for b, f in self.folders.items() if b not in buckets} | {b: f"{folder}/_bucket={b}" for b in held}
        about = json.dumps({"keys": self.keys, "buckets": self.buckets, "schema": self.schema.jsonValue(), "properties": properties})
        manifest = self.spark.createDataFrame([(ABOUT, about), *folders.items()], "bucket int, folder string")
        # Fails if another writer was first: a folder of this name is there.
        manifest.coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/version={version}")
        return Stored(self.spark, self.path, version)

    def change(self, changes: DataFrame, how: Callable[[DataFrame], DataFrame], **properties) -> Stored:
        """`how` of the rows in the buckets of `changes` (which has the keys)."""
        buckets = self.touched(changes)
        return self._next(how(self.read(buckets)), buckets, self.properties | properties)

    def upsert(self, incoming: DataFrame, order: list[str], **properties) -> Stored:
        """IO8: incoming rows replace stored rows of their key, the last one wins."""
        return self.change(incoming, lambda rows: upsert.upsert(rows, incoming, self.keys, order), **properties)

    def insert_absent(self, incoming: DataFrame) -> Stored:
        """IO9: incoming rows whose key is not stored yet."""
        return self.change(incoming, lambda rows: rows.unionByName(upsert.insert_absent(rows, incoming, self.keys)))

    def replace_groups(self, incoming: DataFrame) -> Stored:
        """IO10: all stored rows of an incoming key go, the incoming rows come. The table has one key column."""
        return self.change(incoming, lambda rows: upsert.replace_groups(rows, incoming, self.keys[0]))

    def delete(self, gone: DataFrame) -> Stored:
        """Rows of these keys go."""
        return self.change(gone, lambda rows: rows.join(gone.select(*self.keys).distinct(), self.keys, "left_anti"))

    def keep_configured(self, configured: DataFrame) -> Stored:
        """IO11: rows whose key is still configured stay. Only buckets that lose a row are rewritten; the table has one key column."""
        gone = self.read().select(*self.keys).distinct().join(configured, self.keys, "left_anti")
        return self.delete(gone)

    def replace_all(self, rows: DataFrame, **properties) -> Stored:
        """The whole table anew, in one step; its columns may change."""
        self.schema = rows.schema
        return self._next(rows, set(range(self.buckets)), self.properties | properties)
