"""Headline KPIs: overall totals, categories, payments, order statuses, monthly running total,
review scores.

Measures: *net* revenue is item price; *gross* revenue is price + freight. "avg order value" is
the mean over item rows (the reference's definition), not over orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.calendar import month_start
from ledgerline.functions.category import product_categories
from ledgerline.functions.money import mean_out, money_out
from ledgerline.model import SalesModel
from ledgerline.operators.facts import TS, delivered_items, delivered_order_totals
from ledgerline.operators.topk import distinct_count, share_of_total


def kpi_overall(model: SalesModel, exact: bool = True) -> DataFrame:
    """Delivered orders with items: orders, customers, gross/net/freight revenue, gross mean."""
    rows = delivered_order_totals(model)
    return rows.agg(
        F.count(F.lit(1)).alias("total_orders"),
        distinct_count("customer_id", exact).alias("total_customers"),
        money_out(F.sum("gross")).alias("total_revenue"),
        mean_out(F.sum("gross"), F.sum("gross_n")).alias("avg_order_value"),
        money_out(F.sum("net")).alias("product_revenue"),
        money_out(F.sum("freight")).alias("freight_revenue"),
    )


def category_totals(model: SalesModel, fallback: str | None = "Unknown", flt=None,
                    exact: bool = True) -> DataFrame:
    """(category, orders, _rev, _n) over delivered item rows. One COUNT(DISTINCT order_id): Spark
    aggregates (category, order_id) map-side first, so a hot category still spreads by order."""
    items = delivered_items(model, flt)
    cats = product_categories(model.products, model.category_translation, fallback)
    return items.join(cats, on="product_id", how="inner").groupBy("category").agg(
        distinct_count("order_id", exact).alias("orders"),
        F.sum("price").alias("_rev"),
        F.count("price").alias("_n"),
    )


def category_revenue(model: SalesModel, limit: int = 15, exact: bool = True) -> DataFrame:
    """Top categories by net revenue with mean price and share of *all* categories' revenue
    (the share is taken before the limit)."""
    per_cat = category_totals(model, exact=exact)
    per_cat = share_of_total(per_cat, "_rev", "revenue_pct")
    return per_cat.select(
        "category", "orders",
        money_out("_rev").alias("revenue"),
        mean_out("_rev", "_n").alias("avg_price"),
        "revenue_pct",
    ).orderBy(F.desc("revenue"), F.asc_nulls_last("category")).limit(limit)


def sample_join_top5(model: SalesModel) -> DataFrame:
    """The ingest smoke query: top-5 categories by net revenue with distinct orders."""
    per_cat = category_totals(model)
    return per_cat.select("category", "orders", money_out("_rev").alias("revenue")) \
        .orderBy(F.desc("revenue"), F.asc_nulls_last("category")).limit(5)


def payment_type_summary(model: SalesModel, exact: bool = True) -> DataFrame:
    """Per payment type (all orders): distinct orders, mean and total payment."""
    p = model.order_payments
    return p.groupBy("payment_type").agg(
        distinct_count("order_id", exact).alias("num_orders"),
        mean_out(F.sum("payment_value"), F.count("payment_value")).alias("avg_payment"),
        money_out(F.sum("payment_value")).alias("total_payment"),
    ).orderBy(F.desc("total_payment"), F.asc_nulls_last("payment_type"))


def order_status_breakdown(model: SalesModel) -> DataFrame:
    """Orders per status (all statuses) and percent of all orders."""
    counts = model.orders.groupBy("order_status").agg(F.count(F.lit(1)).alias("order_count"))
    return share_of_total(counts, "order_count", "pct") \
        .orderBy(F.desc("order_count"), F.asc_nulls_last("order_status"))


def monthly_running_total(model: SalesModel) -> DataFrame:
    """Monthly net revenue, running total and 3-month moving average.

    The windows run over the *aggregated* series (one row per calendar month, bounded by the
    calendar span), so the un-partitioned ordering is over a few hundred rows at most."""
    rows = delivered_order_totals(model).select(month_start(TS).alias("month"), "net", "net_n")
    monthly = rows.groupBy("month").agg(F.sum("net").alias("_rev"))
    upto = Window.orderBy("month")  # default frame: unbounded preceding .. current row
    last3 = Window.orderBy("month").rowsBetween(-2, 0)
    return monthly.select(
        "month",
        money_out("_rev").alias("monthly_revenue"),
        money_out(F.sum("_rev").over(upto)).alias("running_total"),
        mean_out(F.sum("_rev").over(last3), F.count("_rev").over(last3)).alias("rolling_3m_avg"),
    ).orderBy("month")


def review_score_distribution(model: SalesModel) -> DataFrame:
    return model.order_reviews.groupBy("review_score") \
        .agg(F.count(F.lit(1)).alias("count")).orderBy("review_score")
