"""Streams from files, and sinks that can be written again after a failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens import session
from fleetlens.sources import upsert


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A stored table as a stream of its files: one file, or a folder of them. A pattern of one name stands for both, where
    a plain path has to be a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder.rstrip('/')}/{{{name}.parquet}}")


def to_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A sink with one folder per micro-batch; a batch that runs again replaces its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], name: str, mode: str = "append", every: str | None = None):
    """Starts the stream: on a schedule with `every`, else over what is there
    now. The checkpoint lies in the shared folder."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", session.shared_dir(spark, f"{name}-checkpoint"))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.foreachBatch(sink).start()


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there now; the rows written, with their batch_id."""
    spark = stream.sparkSession
    path = session.shared_dir(spark, name)
    start(stream, to_folder(path), name, mode).awaitTermination()
    return spark.read.schema(stream.schema.add("batch_id", "long")).parquet(path)


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What an update-mode stream says last about each key."""
    return upsert.last_write(rows, keys, ["batch_id"]).drop("batch_id")
