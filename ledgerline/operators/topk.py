"""Share-of-total, top-k and top-1-per-group building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.money import round_ratio


def share_of_total(df: DataFrame, value: str, out: str, digits: int = 2) -> DataFrame:
    """Add ``out`` = round(value * 100 / sum(value over all rows), digits).

    ``df`` must be a grouped result whose size is bounded by a vocabulary (categories, statuses):
    the whole-frame window then moves at most that many rows to one task, and the expensive
    input plan runs once. (A scalar subquery would re-run the item-level plan for the total.)"""
    total = F.sum(value).over(Window.partitionBy())
    return df.withColumn(out, round_ratio(F.col(value), total, digits, scale=100))


def top1_per_group(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """First row per group under ``order`` (QUALIFY ROW_NUMBER() = 1). Spark plans the filter
    as a per-partition group limit, so each group keeps one candidate before the final window."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def distinct_count(col: str, exact: bool = True, rsd: float = 0.01) -> Column:
    """COUNT(DISTINCT col); ``exact=False`` opts in to HyperLogLog++ (``approx_count_distinct``,
    relative standard deviation ``rsd``), which needs no shuffle by the counted key."""
    return F.countDistinct(col) if exact else F.approx_count_distinct(col, rsd)
