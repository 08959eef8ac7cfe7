"""Regional jobs: revenue by state, top cities, freight burden.

Plan shape (exact and skew-tolerant): items -> order rows -> customer rows -> join customers ->
aggregate by state/city. Each customer lives in one state and city, so distinct orders per state
is the sum of per-customer order counts and distinct customers is a row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.money import mean_out, money_out, round_ratio
from ledgerline.model import SalesModel
from ledgerline.operators.facts import customer_totals, delivered_order_totals


def customer_rows_with_place(model: SalesModel) -> DataFrame:
    cust = customer_totals(delivered_order_totals(model))
    place = model.customers.select("customer_id", "customer_state", "customer_city")
    return cust.join(place, on="customer_id", how="inner")


def state_revenue(model: SalesModel) -> DataFrame:
    rows = customer_rows_with_place(model)
    g = rows.groupBy(F.col("customer_state").alias("state")).agg(
        F.sum("orders").alias("total_orders"),
        F.count(F.lit(1)).alias("unique_customers"),
        F.sum("gross").alias("_gross"),
        F.sum("gross_n").alias("_gross_n"),
        F.sum("freight").alias("_freight"),
    )
    return g.select(
        "state", "total_orders", "unique_customers",
        money_out("_gross").alias("total_revenue"),
        mean_out("_gross", "_gross_n").alias("avg_order_value"),
        round_ratio("_freight", "_gross", 2, scale=100).alias("freight_pct"),
    ).orderBy(F.desc("total_revenue"), F.asc_nulls_last("state"))


def top_cities(model: SalesModel, limit: int = 10) -> DataFrame:
    rows = customer_rows_with_place(model)
    g = rows.groupBy(F.col("customer_city").alias("city"), F.col("customer_state").alias("state")) \
        .agg(F.sum("orders").alias("orders"), F.sum("net").alias("_rev"))
    return g.select("city", "state", "orders", money_out("_rev").alias("revenue")) \
        .orderBy(F.desc("revenue"), F.asc_nulls_last("city"), F.asc_nulls_last("state")) \
        .limit(limit)


def ratio_of_means(num_sum: Column, num_n: Column, den_sum: Column, den_n: Column,
                   digits: int = 2) -> Column:
    """round((num_sum/num_n) / (den_sum/den_n) * 100, digits), NULL when the denominator mean is 0."""
    factor = 100 * 10 ** digits
    num = (num_sum * F.lit(factor)).cast("double") * den_n.cast("double")
    den = F.nullif(den_sum.cast("double") * num_n.cast("double"), F.lit(0.0))
    return F.round(num / den, 0) / F.lit(float(10 ** digits))


def freight_burden(model: SalesModel) -> DataFrame:
    rows = customer_rows_with_place(model)
    g = rows.groupBy(F.col("customer_state").alias("state")).agg(
        F.sum("freight").alias("_f"), F.sum("freight_n").alias("_fn"),
        F.sum("net").alias("_p"), F.sum("net_n").alias("_pn"),
    )
    return g.select(
        "state",
        mean_out("_f", "_fn").alias("avg_freight"),
        mean_out("_p", "_pn").alias("avg_product_price"),
        ratio_of_means(F.col("_f"), F.col("_fn"), F.col("_p"), F.col("_pn"))
        .alias("freight_to_price_ratio_pct"),
    ).orderBy(F.desc_nulls_last("freight_to_price_ratio_pct"), F.asc_nulls_last("state"))
