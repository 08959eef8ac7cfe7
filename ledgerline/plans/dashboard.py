"""Parameterised (dashboard) queries over a :class:`SalesFilter`.

All of them inner-join customers (the reference does), so orders whose customer is unknown drop
out even without a state filter. The forecast and segment panels are unfiltered by design.

``kpi_cards`` reproduces the reference's review fan-out: joining reviews to *item rows* repeats
each item once per review of its order, inflating revenue and weighting ratings by item count.
It is computed exactly from per-order aggregates (item sums x review count), so the fan-out is
never materialised. ``kpi_cards_dedup`` is the corrected variant: revenue over item rows and the
rating averaged per order first, then over orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.calendar import midnight, month_start
from ledgerline.functions.filters import SalesFilter
from ledgerline.functions.money import mean_out, money_out, round_ratio
from ledgerline.model import SalesModel
from ledgerline.operators.facts import TS, delivered_order_totals
from ledgerline.operators.topk import distinct_count
from ledgerline.plans.kpis import category_totals

ALL = SalesFilter()

# The registered filtered variants: one year, three states.
YEAR_AND_STATES = SalesFilter("1997-01-01", "1997-12-31", ("NATION_1", "NATION_7", "NATION_20"))


def date_bounds(model: SalesModel) -> DataFrame:
    day = F.to_date(TS)
    return model.orders.agg(midnight(F.min(day)).alias("min_d"), midnight(F.max(day)).alias("max_d"))


def state_list(model: SalesModel) -> DataFrame:
    return model.customers.select("customer_state").distinct().orderBy("customer_state")


def _order_rows(model: SalesModel, flt: SalesFilter) -> DataFrame:
    return delivered_order_totals(model, flt)


def review_counts(model: SalesModel) -> DataFrame:
    """Per order: review rows, scores and their sum."""
    return model.order_reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_rv_rows"),
        F.count("review_score").alias("_rv_n"),
        F.sum("review_score").alias("_rv_sum"),
    )


def review_fan() -> Column:
    """How often the review join repeats an item of the order."""
    return F.greatest(F.coalesce(F.col("_rv_rows"), F.lit(0)), F.lit(1))


def kpi_cards(model: SalesModel, flt: SalesFilter = ALL, exact: bool = True) -> DataFrame:
    rows = _order_rows(model, flt)
    j = rows.join(review_counts(model), on="order_id", how="left")
    fan = review_fan()
    return j.agg(
        F.count(F.lit(1)).alias("orders"),
        distinct_count("customer_id", exact).alias("customers"),
        money_out(F.sum(F.col("gross") * fan)).alias("revenue"),
        mean_out(F.sum(F.col("gross") * fan), F.sum(F.col("gross_n") * fan)).alias("aov"),
        round_ratio(F.sum(F.col("item_rows") * F.col("_rv_sum")),
                    F.sum(F.col("item_rows") * F.col("_rv_n"))).alias("avg_rating"),
    )


def kpi_cards_dedup(model: SalesModel, flt: SalesFilter = ALL, exact: bool = True) -> DataFrame:
    rows = _order_rows(model, flt)
    reviews = model.order_reviews.groupBy("order_id").agg(
        F.avg("review_score").alias("_score"))
    j = rows.join(reviews, on="order_id", how="left")
    return j.agg(
        F.count(F.lit(1)).alias("orders"),
        distinct_count("customer_id", exact).alias("customers"),
        money_out(F.sum("gross")).alias("revenue"),
        mean_out(F.sum("gross"), F.sum("gross_n")).alias("aov"),
        (F.round(F.avg("_score") * 100, 0) / 100).alias("avg_rating"),
    )


def monthly_revenue_filtered(model: SalesModel, flt: SalesFilter = ALL) -> DataFrame:
    rows = _order_rows(model, flt).withColumn("month", month_start(TS))
    return rows.groupBy("month").agg(
        money_out(F.sum("gross")).alias("revenue"),
        F.count(F.lit(1)).alias("orders"),
    ).orderBy("month")


def category_revenue_filtered(model: SalesModel, flt: SalesFilter = ALL,
                              limit: int = 15) -> DataFrame:
    per_cat = category_totals(model, flt=flt)
    return per_cat.select("category", money_out("_rev").alias("revenue"), "orders") \
        .orderBy(F.desc("revenue"), F.asc_nulls_last("category")).limit(limit)


def state_revenue_filtered(model: SalesModel, flt: SalesFilter = ALL) -> DataFrame:
    rows = delivered_order_totals(model, flt, place=("customer_state",))
    return rows.groupBy(F.col("customer_state").alias("state")).agg(
        money_out(F.sum("gross")).alias("revenue"),
        F.count(F.lit(1)).alias("orders"),
    ).orderBy(F.desc("revenue"), F.asc_nulls_last("state"))


def state_revenue_top10(model: SalesModel, flt: SalesFilter = ALL) -> DataFrame:
    return state_revenue_filtered(model, flt).limit(10)
