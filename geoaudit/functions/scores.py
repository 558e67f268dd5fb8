"""Column expressions that score a region by its counts.

``n`` and ``p`` are a region's points and positive outcomes, ``total`` and ``positive`` those of all points.
Everything stays inside generated code; divisions are guarded, as ANSI mode raises on a zero divisor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIRECTIONS = ("both", "less_in", "less_out")


def rate(p: Column, n: Column) -> Column:
    """p / n; null for an empty region."""
    return F.try_divide(p.cast("double"), n.cast("double"))


def x_log_p(x: Column, p: Column) -> Column:
    """x * ln(p), and 0 where either is not above 0 or unknown."""
    return F.when((x > 0) & (p > 0), x * F.ln(p)).otherwise(F.lit(0.0))


def binomial_fit(n: Column, p: Column) -> Column:
    """Log-likelihood of p positives among n at their own rate."""
    own = rate(p, n)
    return x_log_p(p, own) + x_log_p(n - p, 1 - own)


def likelihood_ratio(n: Column, p: Column, total: Column, positive: Column, direction: str = "both") -> Column:
    """How much better two rates, inside and outside, fit than one; 0 for an empty or all-embracing region.

    The scan statistic of Kulldorff (1997) for binary outcomes. ``less_in`` keeps regions with a lower
    rate inside, ``less_out`` with a higher one; any other direction keeps both. ``positive`` need not be
    the sum of what is scored (simulated worlds are held against the observed one); terms that would need
    the logarithm of a number not above 0 then drop out.
    """
    inside, outside = rate(p, n), rate(positive - p, total - n)
    value = binomial_fit(n, p) + binomial_fit(total - n, positive - p) - binomial_fit(total, positive)
    counted = (total != 0) & (n != 0) & (n != total)
    if direction == "less_in":
        counted &= inside < outside
    elif direction == "less_out":
        counted &= inside > outside
    return F.when(counted, value).otherwise(F.lit(0.0))


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero: the form in which scores are ranked and compared across engines."""
    return F.round(value, digits) + F.lit(0.0)


def central_angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance on the unit sphere, from radians."""
    half = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * F.asin(F.sqrt(half))


def min_cluster_size(fraction: float, n: int, least: int) -> int:
    """A share of the points, rounded half to even, but ``least`` at least."""
    return max(least, round(fraction * n))
