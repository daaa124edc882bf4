"""Ordered computations that hold when one key owns a third of the rows.

A plain window sends all rows of a key to one task. Here a key with more than
`hot_rows` rows is cut at quantiles of its order column into slices; each slice
is one window partition, and one small row per slice carries totals and edges
over to the next. Ordinary keys form a single slice, and when a first count
finds no hot key the plain window is used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import session

LEAST_SLICES = 16
HOT_ROWS = 5_000_000
GRID = 8


def grid(rows: int, size: int, most: int) -> int:
    """In how many blocks of `size` rows a side is cut whose blocks each meet all blocks of the other side. Beyond GRID of them they
    hold up to `most` rows: what a task holds is bounded, and a row is sent to as few tasks as that allows."""
    return min(-(-rows // size), max(GRID, -(-rows // most)))


def small(df: DataFrame, max_rows: int = 10_000, max_bytes: int = 32 << 20) -> DataFrame:
    """`df` with a broadcast hint if it is measured to have at most `max_rows` rows and `max_bytes` bytes
    (as JSON); otherwise as it is, for a shuffled join."""
    head = df.limit(max_rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("_b"))
    rows, size = head.agg(F.count(F.lit(1)), F.coalesce(F.sum("_b"), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys where NULL equals NULL; the right side's keys are dropped."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def sliced(df: DataFrame, keys: list[str], order: Column, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Adds _ord (the numeric order value), _hot and _slice; None when no key has
    more than `hot_rows` rows. The keys are counted first, in a job that reads
    only them. A key gets slices in proportion to its rows. The cuts, a row per hot key, are a written table, so that Spark
    sees its size and picks the join. Rows with equal order values stay in one slice."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot_keys = session.cut(counts, "hot-keys")
    largest = hot_keys.agg(F.max("_n")).first()[0]
    if largest is None:
        return None
    df = df.withColumn("_ord", order)
    slices = max(LEAST_SLICES, -(-4 * largest // hot_rows))  # so that a slice of the largest key is a quarter of hot_rows
    points = [i / slices for i in range(1, slices)]
    at = F.percentile_approx("_ord", points, F.lit(10 * slices)).alias("_cuts")
    if not keys:
        cuts = session.cut(df.agg(at), "cuts").scalar()
        out = df.withColumn("_cuts", cuts)
    else:
        hot = join_null_safe(df.select(*keys, "_ord"), hot_keys.drop("_n"), keys, "left_semi")
        cuts = session.cut(hot.groupBy(*keys).agg(at), "cuts")
        out = join_null_safe(df, cuts, keys)
    slice_no = F.size(F.filter("_cuts", lambda c: c < F.col("_ord")))
    return out.withColumns({"_hot": F.col("_cuts").isNotNull(), "_slice": F.when(F.col("_cuts").isNotNull(), slice_no).otherwise(0)}).drop("_cuts")


def _edges(s: DataFrame, keys: list[str], aggregates: list[Column], carry) -> DataFrame:
    """One row per slice of a hot key, with what `carry` takes from earlier slices."""
    per_slice = s.where("_hot").groupBy(*keys, "_slice").agg(*aggregates)
    return session.cut(per_slice.select(*keys, "_slice", *carry(Window.partitionBy(*keys).orderBy("_slice"))), "edges")


def running(df: DataFrame, keys: list[str], order: Column, tie: list[str], totals: dict[str, Column],
            hot_rows: int = HOT_ROWS) -> DataFrame:
    """Running sums over each key up to and including the row. Row numbers are
    the running sum of 1. `order` must be numeric; `tie` makes it total."""
    s = sliced(df, keys, order, hot_rows)
    if s is None:
        upto = Window.partitionBy(*keys).orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(upto).alias(n) for n, c in totals.items()])
    upto = Window.partitionBy(*keys, "_slice").orderBy("_ord", *tie).rowsBetween(Window.unboundedPreceding, 0)
    edges = _edges(
        s, keys, [F.sum(c).alias(f"_t_{n}") for n, c in totals.items()],
        lambda w: [F.sum(f"_t_{n}").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_before_{n}")
                   for n in totals])
    out = s.select("*", *[F.sum(c).over(upto).alias(n) for n, c in totals.items()])
    out = join_null_safe(out, edges, [*keys, "_slice"])
    for n in totals:
        out = out.withColumn(n, F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)))
    return out.drop("_ord", "_hot", "_slice", *[f"_before_{n}" for n in totals])


def neighbour(df: DataFrame, keys: list[str], order: Column, tie: list[str], values: dict[str, Column],
              following: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Values of the previous row of the key (`following`: of the next one),
    NULL where there is none. `order` and `tie` must be numeric."""
    sign = -1 if following else 1
    tied = [F.col(t) * sign for t in tie]
    packed = F.struct(*[c.alias(n) for n, c in values.items()])
    rest = [c for c in df.columns if c not in values]
    s = sliced(df, keys, order * sign, hot_rows)
    if s is None:
        got = F.lag(packed).over(Window.partitionBy(*keys).orderBy(order * sign, *tied))
        return df.withColumn("_got", got).select(*rest, *[F.col(f"_got.{n}").alias(n) for n in values])
    s = s.withColumn("_v", packed)
    within = Window.partitionBy(*keys, "_slice").orderBy("_ord", *tied)
    rank = F.struct("_ord", *[t.alias(f"_k{i}") for i, t in enumerate(tied)])
    edges = _edges(s, keys, [F.max_by("_v", rank).alias("_last")], lambda w: [F.lag("_last").over(w).alias("_edge")])
    out = s.withColumn("_lag", F.lag("_v").over(within)).withColumn("_first", F.row_number().over(within) == 1)
    out = join_null_safe(out, edges, [*keys, "_slice"])
    got = F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_lag"))
    return out.withColumn("_got", got).select(*rest, *[F.col(f"_got.{n}").alias(n) for n in values])


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, tuple[str, float]],
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """AG3: exact percentiles from counts per distinct value, so that no task
    holds all values of a key. `points`: name -> ('cont' | 'disc', fraction)."""
    counts = session.cut(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")), "counts")
    ranked = running(counts, keys, F.col(value).cast("double"), [], {"_upto": F.col("_c")}, hot_rows)
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = join_null_safe(ranked, total, keys)
    v, first = F.col(value).cast("double"), F.col("_upto") - F.col("_c")

    def at(position: Column) -> Column:
        return F.max(F.when((position >= first) & (position < F.col("_upto")), v))

    parts, finals = [], []
    for name, (kind, p) in points.items():
        if kind == "disc":
            parts.append(at(F.greatest(F.ceil(F.lit(p) * F.col("_n")) - 1, F.lit(0))).alias(name))
            finals.append(F.col(name))
        else:
            position = F.lit(p) * (F.col("_n") - 1)
            parts += [at(F.floor(position)).alias(f"_lo_{name}"), at(F.ceil(position)).alias(f"_hi_{name}"),
                      F.max(position - F.floor(position)).alias(f"_f_{name}")]
            finals.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_f_{name}")).alias(name))
    found = ranked.groupBy(*keys).agg(*parts).select(*keys, *finals)
    # A key that has no value keeps its row.
    return join_null_safe(df.select(*keys).distinct(), found, keys) if keys else found


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """TK4: the first k rows per key. Each task keeps k rows per key before the
    shuffle (window group limit), so a hot key costs k rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
