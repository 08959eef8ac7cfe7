"""Money and ratio expressions.

Money is summed as DECIMAL (exact, order independent) and rounded to cents before it leaves a
job as DOUBLE. Means and ratios are formed as ``round(scaled_numerator / denominator)`` on
doubles: rounding a double to an integer gives the same answer in every IEEE engine, while
rounding to 2 places does not (engines disagree on values such as 1.005).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_out(total: Column | str, digits: int = 2) -> Column:
    """An exact DECIMAL amount, rounded half-up to ``digits`` places, as DOUBLE."""
    return F.round(_col(total), digits).cast("double")


def money_round(total: Column | str, digits: int = 2) -> Column:
    """Rounded but still DECIMAL (for amounts that are summed again later)."""
    return F.round(_col(total), digits)


def round_ratio(numerator: Column | str, denominator: Column | str, digits: int = 2,
                scale: int = 1) -> Column:
    """``round(numerator * scale / denominator, digits)`` as DOUBLE, NULL when the denominator is
    0 or NULL. ``numerator`` may be DECIMAL: it is scaled exactly before the cast."""
    factor = scale * 10 ** digits
    num = (_col(numerator) * F.lit(factor)).cast("double")
    den = F.nullif(_col(denominator).cast("double"), F.lit(0.0))
    return F.round(num / den, 0) / F.lit(float(10 ** digits))


def mean_out(total: Column | str, count: Column | str, digits: int = 2) -> Column:
    """Rounded mean from a DECIMAL/integer sum and a count (``AVG`` without decimal division)."""
    return round_ratio(total, count, digits)
