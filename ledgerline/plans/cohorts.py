"""Monthly cohort retention over delivered orders.

Retention is computed from each customer's *set of active months*: one shuffle by customer with
map-side merging of the sets (a set is bounded by the number of calendar months, however many
orders the customer has, so a hot customer cannot blow up a task). The cohort is the set's
minimum; exploding the set gives each (customer, month) pair exactly once, so active customers per
(cohort, offset) is a plain count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.calendar import month_start, months_between_starts
from ledgerline.functions.money import round_ratio
from ledgerline.model import SalesModel
from ledgerline.operators.facts import TS, delivered_orders


def cohort_assignment(model: SalesModel) -> DataFrame:
    """customer_id -> month of the first delivered order."""
    return delivered_orders(model).groupBy("customer_id") \
        .agg(month_start(F.min(TS)).alias("cohort_month"))


def cohort_activity(model: SalesModel) -> DataFrame:
    """Every delivered order with its customer's cohort month, its own month and the offset."""
    orders = delivered_orders(model).select("customer_id", month_start(TS).alias("order_month"))
    return orders.join(cohort_assignment(model), on="customer_id", how="inner").select(
        "customer_id", "cohort_month", "order_month",
        months_between_starts("cohort_month", "order_month").alias("month_number"),
    )


def customer_active_months(model: SalesModel) -> DataFrame:
    """(customer_id, cohort_month, order_month, month_number), one row per active month."""
    sets = delivered_orders(model).groupBy("customer_id") \
        .agg(F.collect_set(month_start(TS)).alias("_months"))
    pairs = sets.select("customer_id", F.array_min("_months").alias("cohort_month"),
                        F.explode("_months").alias("order_month"))
    return pairs.withColumn("month_number", months_between_starts("cohort_month", "order_month"))


def cohort_sizes(model: SalesModel) -> DataFrame:
    """Customers per cohort (every customer is active at offset 0 of its own cohort)."""
    return cohort_assignment(model).groupBy("cohort_month") \
        .agg(F.count(F.lit(1)).alias("cohort_size"))


def cohort_retention(model: SalesModel) -> DataFrame:
    active = customer_active_months(model).groupBy("cohort_month", "month_number") \
        .agg(F.count(F.lit(1)).alias("active_customers"))
    sizes = active.filter(F.col("month_number") == 0) \
        .select("cohort_month", F.col("active_customers").alias("cohort_size"))
    # Both sides have one row per (cohort, offset) / cohort: bounded by the calendar span.
    return active.join(F.broadcast(sizes), on="cohort_month", how="inner").select(
        "cohort_month", "month_number", "active_customers", "cohort_size",
        round_ratio("active_customers", "cohort_size", 2, scale=100).alias("retention_rate_pct"),
    ).orderBy("cohort_month", "month_number")
