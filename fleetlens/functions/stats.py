"""Statistics as closed-form expressions over sums and counts (UD6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.959963984540054


def pass_rate(passed) -> Column:
    """AG14: percentage of true values, one decimal; an aggregate. NULL counts as not passed."""
    return F.round(F.avg(F.coalesce(passed.cast("double"), F.lit(0.0))) * 100, 1)


def _wilson(passed, n, z):
    p = passed / n
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z / denom
    return centre, half


def wilson_low(passed, n, z: float = Z_95) -> Column:
    """AG16: lower bound in percent, NULL for no cases."""
    centre, half = _wilson(passed.cast("double"), F.nullif(n.cast("double"), F.lit(0.0)), F.lit(z))
    return F.when(n > 0, F.round(100 * F.greatest(F.lit(0.0), centre - half), 1))


def wilson_high(passed, n, z: float = Z_95) -> Column:
    """AG16: upper bound in percent, NULL for no cases."""
    centre, half = _wilson(passed.cast("double"), F.nullif(n.cast("double"), F.lit(0.0)), F.lit(z))
    return F.when(n > 0, F.round(100 * F.least(F.lit(1.0), centre + half), 1))


def weighted_kappa(x, y) -> Column:
    """AG17: quadratic-weighted agreement of two integer ratings; an aggregate.

    With quadratic weights both the observed and the expected disagreement
    follow from the first and second moments, so no matrix is built. Exact
    integers decide whether it is defined."""
    def total(c):
        return F.sum(c.cast("decimal(19,0)"))

    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).cast("decimal(19,0)")
    observed = n.cast("double") * total((x - y) * (x - y)).cast("double")
    expected = (n * (total(x * x) + total(y * y)) - 2 * total(x) * total(y)).cast("double")
    return F.when((n >= 2) & (expected != 0), F.round(1 - F.try_divide(observed, expected), 3))


def intervals_overlap(lo_a, hi_a, lo_b, hi_b) -> Column:
    """DP38: two intervals share a point; a missing one shares none."""
    return F.coalesce((lo_a <= hi_b) & (lo_b <= hi_a), F.lit(False))
