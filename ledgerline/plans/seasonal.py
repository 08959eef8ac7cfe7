"""Seasonal jobs: monthly trends, weekday and hour-of-day patterns, peak month per category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.calendar import (
    hour_of, month_name, month_start, weekday_abbrev, weekday_name, weekday_number,
)
from ledgerline.functions.category import product_categories
from ledgerline.functions.money import mean_out, money_out
from ledgerline.model import SalesModel
from ledgerline.operators.facts import TS, delivered_items, delivered_order_totals
from ledgerline.operators.topk import distinct_count, top1_per_group


def monthly_trend(model: SalesModel, exact: bool = True) -> DataFrame:
    rows = delivered_order_totals(model).withColumn("month", month_start(TS))
    return rows.groupBy("month").agg(
        F.count(F.lit(1)).alias("orders"),
        distinct_count("customer_id", exact).alias("customers"),
        money_out(F.sum("net")).alias("revenue"),
        mean_out(F.sum("net"), F.sum("net_n")).alias("aov"),
    ).orderBy("month")


def monthly_gross_trend(model: SalesModel) -> DataFrame:
    rows = delivered_order_totals(model).withColumn("month", month_start(TS))
    return rows.groupBy("month").agg(
        money_out(F.sum("gross")).alias("revenue"),
        F.count(F.lit(1)).alias("orders"),
    ).orderBy("month")


def revenue_by_dow(model: SalesModel) -> DataFrame:
    """Per weekday: item rows ("orders" in the reference is COUNT(*) over item rows) and mean price."""
    rows = delivered_order_totals(model)
    return rows.groupBy(weekday_name(TS).alias("day_of_week"), weekday_number(TS).alias("day_num")) \
        .agg(F.sum("item_rows").alias("orders"),
             mean_out(F.sum("net"), F.sum("net_n")).alias("avg_order_value")) \
        .orderBy("day_num")


def orders_by_hour(model: SalesModel) -> DataFrame:
    """Orders per hour of day, every status."""
    return model.clock.groupBy(hour_of(TS).alias("hour")) \
        .agg(F.count(F.lit(1)).alias("orders")).orderBy("hour")


def dow_hour_counts(model: SalesModel) -> DataFrame:
    return model.clock.groupBy(weekday_number(TS).alias("dow"), hour_of(TS).alias("hour")) \
        .agg(F.count(F.lit(1)).alias("orders"))


HOURS = list(range(24))


def dow_hour_heatmap(model: SalesModel) -> DataFrame:
    """Weekday x hour matrix with all 24 hour columns (h00..h23), missing cells 0."""
    counts = dow_hour_counts(model)
    pivot = counts.groupBy("dow").pivot("hour", HOURS).agg(F.sum("orders"))
    cells = [F.coalesce(F.col(str(h)), F.lit(0)).cast("bigint").alias(f"h{h:02d}") for h in HOURS]
    return pivot.select(weekday_abbrev("dow").alias("day"), "dow", *cells).orderBy("dow")


def peak_month_by_category(model: SalesModel, limit: int = 15) -> DataFrame:
    """Per category (translation or raw key, no 'Unknown' fallback) the month name with most net
    revenue, months of all years pooled; ties go to the alphabetically first month."""
    items = delivered_items(model, order_columns=(TS,))
    cats = product_categories(model.products, model.category_translation, fallback=None)
    g = items.join(cats, on="product_id", how="inner") \
        .groupBy("category", month_name(TS).alias("peak_month")) \
        .agg(F.sum("price").alias("_rev"))
    g = g.withColumn("revenue", money_out("_rev"))
    best = top1_per_group(g, ["category"], [F.desc("revenue"), F.asc("peak_month")])
    return best.select("category", "peak_month", "revenue") \
        .orderBy(F.desc("revenue"), F.asc_nulls_last("category")).limit(limit)
