"""What the operators share: reading tables, bounded slices of a batch, files handed to the workers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import configure, cut

__all__ = ["BATCH_BYTES", "BATCH_KEY", "SLICE_BYTES", "cut", "handed_out", "let", "slices", "table", "text_slices"]

#: A worker handles about so many bytes of text at a time, however many rows a batch has.
SLICE_BYTES = 1 << 20

#: Texts and sets go to the workers in batches of so many bytes, where this is set; Spark's own bound is 64 MB a task, held on both sides.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the session is made ready for the workers first."""
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes each; a row that is larger stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(column, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """The texts of a batch's column, a bounded slice at a time: only that slice is ever Python strings."""
    for a, b in slices(pc.binary_length(column).to_pylist(), most):
        yield a, b, column[a:b].to_pylist()


def handed_out(spark: SparkSession, path: str) -> tuple[str, Broadcast]:
    """A vocabulary file's content for every worker, and a key to keep what is built of it by.
    Its size is that of the vocabulary, whatever the input."""
    content = Path(path).read_bytes()
    return hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)
