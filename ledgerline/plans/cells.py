"""Saved additive cells for the dashboard cards: any date range and state list without the items.

``save_sales_cells`` writes two named tables once:

* ``sales_cells``: one row per (day, state) with the sums that the cards are made of;
* ``customer_bitmaps``: who bought, as bitmaps over dense customer numbers, per (day, state) and per (month, state).

Distinct customers don't add up, but bitmaps do: a click takes the month rows of whole months, the day rows of the broken months at
both ends, merges the bitmaps with OR per bucket of 32,768 numbers and counts bits. Numbers are dealt by state, so a cell touches
only its state's buckets and bitmaps are as full as they can be. The count is exact. ``sketches=True`` also stores an HLL sketch per cell,
for an approximate count that reads no bitmap.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.filters import SalesFilter, as_date
from ledgerline.functions.money import mean_out, money_out, round_ratio
from ledgerline.model import SalesModel
from ledgerline.operators.facts import TS, delivered_order_totals
from ledgerline.operators.ranking import global_rank
from ledgerline.plans.dashboard import ALL, YEAR_AND_STATES, review_counts, review_fan
from ledgerline.session import cut_lineage
from ledgerline.sources.tables import open_table, write_table

CELLS, BITMAPS = "sales_cells", "customer_bitmaps"


def save_sales_cells(model: SalesModel, root: str | None = None, sketches: bool = False) -> tuple[DataFrame, DataFrame]:
    """Replace both tables and reopen them. Orders of unknown customers are left out, as on the dashboard."""
    rows = delivered_order_totals(model, ALL, place=("customer_state",)).join(review_counts(model), "order_id", "left")
    fan = review_fan()
    orders = cut_lineage(rows.select(
        F.to_date(TS).alias("day"), "customer_state", "customer_id", (F.col("gross") * fan).alias("revenue"), (F.col("gross_n") * fan).alias("revenue_n"),
        (F.col("item_rows") * F.col("_rv_sum")).alias("rating"), (F.col("item_rows") * F.col("_rv_n")).alias("rating_n")), "cell-orders")
    sums = [F.count(F.lit(1)).alias("orders"), *[F.sum(c).alias(c) for c in ("revenue", "revenue_n", "rating", "rating_n")]]
    if sketches:
        sums.append(F.hll_sketch_agg("customer_id").alias("customers"))
    cells = write_table(orders.groupBy("day", "customer_state").agg(*sums), CELLS, root)

    buyers = orders.groupBy("customer_state", "customer_id").agg(F.lit(1).alias("one")).drop("one")
    numbered = global_rank(buyers, [F.col("customer_state").asc(), F.col("customer_id").asc()], rank_col="number")
    visits = orders.select("day", "customer_state", "customer_id").distinct().join(
        numbered.select("customer_id", F.col("customer_state").alias("_s"), "number"),
        (F.col("_s").eqNullSafe(F.col("customer_state"))) & (orders["customer_id"] == numbered["customer_id"])).select("day", "customer_state", "number")
    visits = visits.select(F.trunc("day", "month").alias("month"), "day", "customer_state", F.bitmap_bucket_number("number").alias("bucket"),
                           F.bitmap_bit_position("number").alias("bit"))
    by_day = visits.groupBy("month", "day", "customer_state", "bucket").agg(F.bitmap_construct_agg("bit").alias("buyers"))
    by_day = cut_lineage(by_day, "day-bitmaps")
    by_month = by_day.groupBy("month", F.lit(None).cast("date").alias("day"), "customer_state", "bucket").agg(F.bitmap_or_agg("buyers").alias("buyers"))
    return cells, write_table(by_day.unionByName(by_month), BITMAPS, root)


def _whole_months(start: dt.date | None, end: dt.date | None) -> tuple[dt.date | None, dt.date | None]:
    """The first month and the month after the last one that lie in the range as a whole."""
    first = start and (start if start.day == 1 else (start.replace(day=1) + dt.timedelta(days=32)).replace(day=1))
    after = end and (end + dt.timedelta(days=1)).replace(day=1)
    return first, after


def bitmap_rows(flt: SalesFilter) -> Column:
    """The rows of ``customer_bitmaps`` whose union is the range: whole months, and single days of broken ones."""
    start, end = as_date(flt.start), as_date(flt.end)
    first, after = _whole_months(start, end)
    whole = F.lit(True)
    if first is not None:
        whole = whole & (F.col("month") >= F.lit(first))
    if after is not None:
        whole = whole & (F.col("month") < F.lit(after))
    in_range = F.lit(True)
    if start is not None:
        in_range = in_range & (F.col("day") >= F.lit(start))
    if end is not None:
        in_range = in_range & (F.col("day") <= F.lit(end))
    return (F.col("day").isNull() & whole) | (F.col("day").isNotNull() & ~whole & in_range)


def cards_from_cells(cells: DataFrame, bitmaps: DataFrame, flt: SalesFilter = ALL, exact: bool = True) -> DataFrame:
    """The row of ``kpi_cards(model, flt)`` from the saved tables. ``exact=False`` reads sketches instead of bitmaps."""
    start, end = as_date(flt.start), as_date(flt.end)
    picked = cells.filter(flt.state_predicate("customer_state"))
    if start is not None:
        picked = picked.filter(F.col("day") >= F.lit(start))
    if end is not None:
        picked = picked.filter(F.col("day") <= F.lit(end))
    if exact:
        merged = bitmaps.filter(bitmap_rows(flt) & flt.state_predicate("customer_state")).groupBy("bucket").agg(F.bitmap_or_agg("buyers").alias("buyers"))
        customers = F.coalesce(merged.agg(F.sum(F.bitmap_count("buyers"))).scalar(), F.lit(0).cast("long"))
    elif "customers" in cells.columns:
        customers = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("customers")), F.lit(0).cast("long"))
    else:
        raise ValueError("the cells were saved without sketches")
    return picked.agg(
        F.coalesce(F.sum("orders"), F.lit(0).cast("long")).alias("orders"), customers.alias("customers"), money_out(F.sum("revenue")).alias("revenue"),
        mean_out(F.sum("revenue"), F.sum("revenue_n")).alias("aov"), round_ratio(F.sum("rating"), F.sum("rating_n")).alias("avg_rating"))


def kpi_cards_saved(spark: SparkSession, flt: SalesFilter = ALL, root: str | None = None, exact: bool = True) -> DataFrame:
    """The cards of a click: reads the two saved tables and nothing else."""
    return cards_from_cells(open_table(spark, CELLS, root), open_table(spark, BITMAPS, root), flt, exact)


def kpi_cards_cells(model: SalesModel, flt: SalesFilter = ALL, root: str | None = None) -> DataFrame:
    """Save the cells and read the cards from them."""
    return cards_from_cells(*save_sales_cells(model, root), flt)


def kpi_cards_cells_year_states(model: SalesModel) -> DataFrame:
    return kpi_cards_cells(model, YEAR_AND_STATES)
