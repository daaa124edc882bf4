"""Documents as they arrive (ST13)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import session
from fleetlens.operators import documents
from fleetlens.sources.stored import Stored

LOG = "doc_id long, content_hash string, status string, batch_id long"
#: The ledger in one table, so that one version says all: under a document its hash ("d"), under a hash its documents ("h").
LEDGER = "kind string, key string, doc_id long, content_hash string"
BUCKETS = 64


def entries(rows: DataFrame) -> DataFrame:
    """doc_id, content_hash as entries of the ledger."""
    kinds = F.array(F.struct(F.lit("d").alias("kind"), F.col("doc_id").cast("string").alias("key")), F.struct(F.lit("h").alias("kind"), F.col("content_hash").alias("key")))
    return rows.select(F.inline(kinds), "doc_id", "content_hash")


def ledger(spark: SparkSession, path: str, before: int | None = None, buckets: int = BUCKETS) -> Stored:
    """The ledger, or the version `before` a micro-batch that runs a second time."""
    path = f"{path.rstrip('/')}-ledger"
    try:
        table = Stored(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        table = Stored.create(spark.createDataFrame([], LEDGER), path, ["kind", "key"], buckets, {"batch": -1})
    while before is not None and table.properties["batch"] >= before:
        table = Stored(spark, table.path, table.version - 1)
    return table


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The newest hash of each document written so far."""
    return ledger(spark, path).read().where("kind = 'd'").select("doc_id", "content_hash")


def ingest_sink(path: str, buckets: int = BUCKETS):
    """Each micro-batch against what is stored: exact copies are skipped, changed documents replace their old version.
    The log has one folder per batch, the ledger lies beside it. A batch reads the ledger's buckets of its own documents and hashes, and rewrites
    those that change, so it costs what it touches, however long the log is."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = ledger(spark, path, batch_id, buckets)
        hashes = documents.hashed(batch)
        known = table.read(table.touched(entries(hashes))).select("doc_id", "content_hash").distinct()
        status = documents.hash_status(hashes, known)
        log = f"{path}/batch_id={batch_id}"
        status.write.mode("overwrite").parquet(log)
        if ledger(spark, path).properties["batch"] >= batch_id:
            return
        taken = spark.read.schema(status.schema).parquet(log).where("status IN ('ingested', 'replaced')").select("doc_id", "content_hash")
        old = known.join(taken.select("doc_id"), "doc_id", "left_semi")
        gone, new = session.cut(entries(old), "gone"), entries(taken)
        table.change(gone.unionByName(new), lambda rows: rows.join(gone, ["kind", "key", "doc_id"], "left_anti").unionByName(new), batch=batch_id)

    return write
