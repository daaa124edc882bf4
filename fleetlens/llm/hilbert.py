"""Shards cut from a Hilbert curve through several metadata columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window
from pyspark.sql.types import NumericType

from fleetlens.llm.frames import cut

#: Bits of each dimension's bin number.
BITS = 6
#: Bins of values are broadcast up to so many bytes; beyond that the join is shuffled.
BROADCAST_BYTES = 32 << 20


def curve_index(bins: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of bin numbers (rows x dimensions).

    Each level of the curve, from the coarsest bit down, turns and mirrors the cube below it; undoing those turns bit by bit
    leaves the Gray code of the place (Skilling 2004)."""
    x = [bins[:, i].astype(np.int64) for i in range(bins.shape[1])]
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            mirrored = (x[i] & bit) != 0
            swap = np.where(mirrored, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(mirrored, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        bit >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn = np.where((x[n - 1] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | (((x[i] ^ turn) >> b) & 1)
    return place


def value_bins(docs: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """value and bin of every distinct value of a column, in the order of whole values: the share of rows with a smaller value, in
    steps of one in 2^bits.

    Values are counted first, then range-partitioned and sorted; running counts within a partition and a number for
    each partition give the share, so that no task sees all values."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = docs.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    counts = cut(counts.repartitionByRange(parts, "value").withColumn("_part", F.spark_partition_id()), "values")
    totals = sorted((r["_part"], r["n"]) for r in counts.groupBy("_part").agg(F.sum("n").alias("n")).collect())
    before = [(p, sum(n for q, n in totals if q < p)) for p, _ in totals]
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, "_part int, _before long"))  # a row for each partition
    total = max(sum(n for _, n in totals), 1)
    smaller = F.col("_before") + F.sum("n").over(Window.partitionBy("_part").orderBy("value")) - F.col("n")
    return counts.join(offsets, "_part").select("value", F.floor(smaller * (1 << bits) / total).cast("int").alias("bin"))


def with_curve(docs: DataFrame, dimensions: list[str], bits: int = BITS, to: str = "curve") -> DataFrame:
    """Adds the curve index of the named columns. Bins are quantiles over all rows: of numbers from one
    aggregate of fixed size, of other columns from counts of their whole values. A null is in the first bin."""
    numeric = [isinstance(docs.schema[d].dataType, NumericType) for d in dimensions]
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = [d for d, n in zip(dimensions, numeric) if n]
    edges = docs.agg(*[F.percentile_approx(F.col(d).cast("double"), steps, 10_000) for d in numbers], F.count("*")).first()
    found = {d: np.array(edges[i] or [], float) for i, d in enumerate(numbers)}
    rows, columns, names = docs, [], []
    for i, d in enumerate(dimensions):
        if numeric[i]:
            columns.append(F.col(d).cast("double"))
            continue
        names.append(f"_bin{i}")
        bins = cut(value_bins(docs, d, bits), "value-bins")
        bins = bins.select(F.col("value").alias(f"_value{i}"), F.col("bin").alias(names[-1]))
        size = bins.agg(F.coalesce(F.sum(F.octet_length(F.col(f"_value{i}").cast("string")) + 32), F.lit(0))).first()[0]
        rows = rows.join(F.broadcast(bins) if size <= BROADCAST_BYTES else bins, F.col(d) == F.col(f"_value{i}"), "left").drop(f"_value{i}")
        columns.append(F.col(names[-1]).cast("double"))

    @F.arrow_udf("long")
    def place(*given: pa.Array) -> pa.Array:
        bins = []
        for column, d in zip(given, dimensions):
            values = column.to_numpy(zero_copy_only=False).astype(float)
            bins.append(np.where(np.isnan(values), 0, np.searchsorted(found[d], values, "left") if d in found else values).astype(np.int64))
        return pa.array(curve_index(np.stack(bins, 1), bits), pa.int64())

    return rows.withColumn(to, place(*columns)).drop(*names)


def assign_shards(docs: DataFrame, shards: int = 40, dimensions: tuple[str, ...] = ("lang", "source", "n_chars"), text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and curve of every row, by the law `rows`: the rows, sorted by curve
    index, are cut into runs whose lengths differ by one at most; slot counts from 0 within a shard.

    Only keys, sizes and bins are shuffled, never texts. Rows are range-partitioned by (curve, text crc, key, row), so a cell of the curve
    that holds a third of all rows is split like any other; each partition's length, one number a partition, gives the global place.

    A null or empty text has size 16 and crc 0. Null keys come first within a cell, repeated rows get a slot each, null dimensions
    fall into the first bin. An empty table gives an empty result. With fewer rows than shards the last shards are empty.
    Columns other than the named ones are not read."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(key).alias("_key"), (F.octet_length(whole) + 16).cast("long").alias("_size"), F.crc32(F.encode(whole, "UTF-8")).alias("_crc"),
        F.monotonically_increasing_id().alias("_row"), *[F.col(d).alias(f"_d{i}") for i, d in enumerate(dimensions)])
    slim = cut(slim, "shard-rows")
    order = ["_curve", "_crc", "_key", "_row"]
    placed = with_curve(slim, [f"_d{i}" for i in range(len(dimensions))], to="_curve").select("_key", "_size", "_crc", "_row", "_curve")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = cut(placed, "shard-order")
    lengths = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in sorted(lengths):
        before.append((p, total))
        total += lengths[p]
    offsets = F.broadcast(spark.createDataFrame(before, "_part int, _before long"))  # a row for each partition
    short, longer = divmod(total, shards)
    place = F.col("_before") + F.col("_at")
    border = longer * (short + 1)
    shard = F.when(place < border, F.floor(place / (short + 1))).otherwise(longer + F.floor((place - border) / max(short, 1)))
    start = F.when(F.col("shard") < longer, F.col("shard").cast("long") * (short + 1)).otherwise(border + (F.col("shard").cast("long") - longer) * short)
    return (
        placed.join(offsets, "_part").withColumn("shard", shard.cast("int")).withColumn("slot", place - start)
        .select(F.col("_key").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                F.lit(None).cast("int").alias("grown_shard"), F.col("_curve").alias("curve"))
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes the rows into one folder a shard, in curve order, so that the minima and maxima of each file's columns
    are narrow. `key` has to be unique. Each shard is one task's file."""
    place = assigned.select(F.col("doc_id").alias("_key"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = docs.join(place, docs[key].eqNullSafe(F.col("_key"))).drop("_key")
    rows.repartition("_shard").sortWithinPartitions("_shard", "_slot").drop("_slot").write.partitionBy("_shard").parquet(path)
