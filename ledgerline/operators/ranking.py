"""Exact global ranks, NTILE and quantile bins without a single-partition window.

``row_number() OVER (ORDER BY ...)`` with no PARTITION BY moves every row into one task. Here the
rank is built the way a distributed sort is:

1. ``orderBy`` range-partitions and sorts the rows (the ordering must be total -- callers append
   a unique key -- so heavy ties on the measure are spread across partitions by that key);
2. ``monotonically_increasing_id`` numbers rows inside each sorted partition (high bits are the
   partition index), and the result is checkpointed (reliably, to ``spark.checkpoint.dir``) so
   that numbering is fixed even if executors are lost and stages are retried;
3. per-partition row counts (one row per partition) are prefix-summed into offsets and joined back
   as a broadcast (its size is bounded by the partition count, not by the data);
4. ``rank = offset + position in partition``; n is a scalar subquery over the counts.

Order statistics need no ranks of all rows: :func:`~ledgerline.operators.selection.rows_at_ranks` finds the rows at given
ranks (tile boundaries, quantile edges) by counting, without a sort. :func:`global_rank`, :func:`ntile` and :func:`quantile_edges` stay for
callers who want the rank, tile or edges of a frame of their own, where every row needs its number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.selection import rows_at_ranks  # noqa: F401 (part of this module's interface)
from ledgerline.session import cut_lineage

_LOW_BITS = (1 << 33) - 1


def global_rank(df: DataFrame, order: list[Column], rank_col: str = "rank",
                count_col: str | None = None) -> DataFrame:
    """Add ``rank_col`` = 1-based position under ``order`` (which must be a total order), and
    optionally ``count_col`` = number of rows."""
    numbered = cut_lineage(df.orderBy(*order).withColumn("_rid", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_pid", F.shiftright("_rid", 33))
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    ranked = numbered.join(F.broadcast(offsets), on="_pid", how="inner").withColumn(
        rank_col, F.col("_off") + F.col("_rid").bitwiseAND(F.lit(_LOW_BITS)) + F.lit(1))
    if count_col:
        ranked = ranked.withColumn(count_col, counts.agg(F.sum("_cnt")).scalar())
    return ranked.drop("_rid", "_pid", "_off")


def ntile_of_rank(rank: Column, n: Column, k: int) -> Column:
    """NTILE(k) from a 1-based rank among n rows: the first n % k tiles get one extra row."""
    q = F.floor(n / F.lit(k)).cast("bigint")
    m = (n - q * F.lit(k)).cast("bigint")
    big = m * (q + F.lit(1))
    first = F.ceil(rank / (q + F.lit(1)))
    rest = m + F.ceil((rank - big) / F.nullif(q, F.lit(0)))
    return F.when(rank <= big, first).otherwise(rest).cast("bigint")


def ntile(df: DataFrame, order: list[Column], k: int, out: str) -> DataFrame:
    ranked = global_rank(df, order, rank_col="_rank", count_col="_n")
    return ranked.withColumn(out, ntile_of_rank(F.col("_rank"), F.col("_n"), k)).drop("_rank", "_n")


def tile_starts(n: int, k: int) -> list[int]:
    """The ranks at which the tiles 2..k of NTILE(k) over n rows begin (tiles without rows have none)."""
    size, more = divmod(n, k)
    starts = [1 + t * size + min(t, more) for t in range(1, k)]
    return [r for r in starts if r <= n]


def at_or_above(df: DataFrame, measure: str, key: str, bounds: list[tuple]) -> Column:
    """How many of the boundary rows (measure, key) a row reaches in the order (measure, key)."""
    here = F.struct(F.col(measure).alias("m"), F.col(key).alias("k"))
    total = F.lit(0)
    for value, row_key in bounds:
        bound = F.struct(F.lit(value).cast(df.schema[measure].dataType).alias("m"), F.lit(row_key).cast(df.schema[key].dataType).alias("k"))
        total = total + F.when(here >= bound, 1).otherwise(0)
    return total


QUINTILES = (0.2, 0.4, 0.6, 0.8)


def _quantile_positions(n: int, probs) -> list[tuple[float, int, int, float]]:
    """(p, lo_rank, hi_rank, fraction) per probability, linear interpolation between order
    statistics at 0-based position (n - 1) * p."""
    out = []
    for p in probs:
        pos = float(n - 1) * p
        lo = math.floor(pos)
        hi = math.ceil(pos)
        out.append((p, lo + 1, hi + 1, pos - lo))
    return out


def interpolated(values: dict[int, float], n: int, probs=(0.0,) + QUINTILES + (1.0,)) -> list[float]:
    """Linear-interpolation quantiles from the values at the ranks of :func:`quantile_ranks`."""
    edges = []
    for _, lo, hi, frac in _quantile_positions(n, probs):
        a, b = values[lo], values[hi]
        edges.append(a if lo == hi else a + (b - a) * frac)
    return edges


def quantile_ranks(n: int, probs=(0.0,) + QUINTILES + (1.0,)) -> list[int]:
    """The ranks that linear interpolation needs."""
    return sorted({r for _, lo, hi, _ in _quantile_positions(n, probs) for r in (lo, hi)})


def quantile_edges(ranked: DataFrame, value: str, rank_col: str, n: int,
                   probs=(0.0,) + QUINTILES + (1.0,)) -> list[float]:
    """Exact linear-interpolation quantiles of ``value`` from a ranked frame (n rows)."""
    if n <= 0:
        return []
    wanted = quantile_ranks(n, probs)
    picked = dict(ranked.filter(F.col(rank_col).isin(wanted))
                  .select(rank_col, F.col(value).cast("double")).collect())
    return interpolated(picked, n, probs)


def count_edges_below(value: Column, interior_edges: list[float]) -> Column:
    """How many interior edges lie strictly below ``value`` (the 0-based right-closed bin)."""
    total = F.lit(0)
    for e in interior_edges:
        total = total + F.when(value > F.lit(float(e)), 1).otherwise(0)
    return total


def require_unique_edges(edges: list[float], what: str) -> None:
    if len(set(edges)) != len(edges):
        raise ValueError(f"Bin edges must be unique for {what}: {edges}")
