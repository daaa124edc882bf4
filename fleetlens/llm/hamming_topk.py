"""Exact nearest binary codes by multi-index hashing, its radius grown until the answer is proven."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from fleetlens.llm.frames import cut

BITS, SEGMENTS = 64, 4
SEGMENT_BITS = BITS // SEGMENTS


def sign_code(vector: Column) -> Column:
    """One bit a dimension, set where the value is at least 0; null for a null or empty vector or one with a null value
    in it. A code has 64 bits: a vector of more dimensions is an error while the job runs, as the answers would be those of a part of it."""
    wide = F.raise_error(F.lit(f"vectors of more than {BITS} dimensions have no code"))
    bits = F.transform(F.slice(vector, 1, BITS), lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) > BITS, wide.cast("long")).when((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()), code)


def _segment(code: Column, s: int) -> Column:
    return F.shiftrightunsigned(code, s * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).cast("int")


def _masks(radius: int) -> list[int]:
    """All segment values with so many bits set."""
    return [m for m in range(1 << SEGMENT_BITS) if m.bit_count() == radius]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", code: str = "code") -> DataFrame:
    """query_id, rank (from 1), neighbour_id and distance: the k rows other than the query itself with the least Hamming distance
    to its 64-bit code, ties by the smaller id. Exact.

    Equal codes are folded: a code is indexed once, with its k + 1 smallest ids, and equal queries are answered once, so neither a
    vector that a third of the rows share nor a third of the queries meets in one task. The index has a row for each code
    and 16-bit segment. In round r all active queries look up the segment values that differ in exactly r bits; a code within
    distance 4(r + 1) - 1 has by then been met in some segment. A meeting counts only at the first segment with the least
    difference, so no pair is met twice and none has to be removed. A query whose k-th distance is within that reach is done; the others
    go on to r + 1. Rounds are written to the shared folder, so lost executors cost one round.

    Rows with a null key or code are no neighbours and no queries. Repeated ids count once for each row's code. With fewer than k other rows all of them
    are returned. Empty tables give an empty result. Other columns are not read."""
    spark = rows.sparkSession
    most = k + 1
    clean = rows.select(F.col(key).cast("long").alias("id"), F.col(code).alias("code")).where("id is not null and code is not null").distinct()
    by_code = Window.partitionBy("code").orderBy("id")
    folded = cut(
        clean.withColumn("n", F.row_number().over(by_code)).where(F.col("n") <= most)
        .groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "hamming-codes")
    held, ids = folded.agg(F.count("*"), F.sum(F.size("ids"))).first()
    enough = min(most, ids or 0)
    index = cut(folded.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), _segment(F.col("code"), s).alias("v")) for s in range(SEGMENTS)])).alias("_at"), "code", "ids").select("_at.*", "code", "ids"), "hamming-index")
    asked = queries.select(F.col(key).cast("long").alias("query_id"), F.col(code).alias("q")).where("query_id is not null and q is not null").distinct()
    asked = cut(asked, "hamming-queries")
    active = asked.select("q").distinct()
    best, done = None, []
    for radius in range(SEGMENT_BITS + 1):
        masks = F.explode(F.lit(_masks(radius)))
        probes = active.select("q", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), _segment(F.col("q"), s).alias("own")) for s in range(SEGMENTS)])).alias("_p"))
        probes = probes.select("q", "_p.s", "_p.own", masks.alias("mask")).select("q", "s", F.col("own").bitwiseXOR(F.col("mask")).alias("v"))
        apart = [F.bit_count(_segment(F.col("q"), s).bitwiseXOR(_segment(F.col("code"), s))) for s in range(SEGMENTS)]
        first = F.lit(True)
        for s in range(SEGMENTS):
            first = first & (apart[s] >= radius) & ((F.col("s") <= s) | (apart[s] > radius))
        # Sorted on both sides: a hash table of either on the driver would grow with the rows.
        met = probes.join(index.hint("merge"), ["s", "v"]).where(first).select("q", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).alias("distance"), F.explode("ids").alias("id"))
        pool = met if best is None else met.unionByName(best)
        ranked = pool.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("n") <= most).drop("n")
        ranked = cut(ranked, "hamming-round")
        reach = SEGMENTS * (radius + 1) - 1
        state = ranked.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        proven = state.where((F.col("n") >= enough) & (F.col("far") <= reach)).select("q").hint("merge")
        done.append(ranked.join(proven, "q", "left_semi"))
        active = cut(active.join(proven, "q", "left_anti"), "hamming-active")
        if active.isEmpty():
            break
        best = ranked.join(proven, "q", "left_anti")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    lists = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))
    own = F.filter("near", lambda x: x["id"] != F.col("query_id"))
    return (
        asked.join(lists.hint("merge"), "q").select("query_id", F.posexplode(F.slice(own, 1, k)).alias("pos", "hit"))
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("neighbour_id"), F.col("hit.distance").cast("int").alias("distance"))
    )
