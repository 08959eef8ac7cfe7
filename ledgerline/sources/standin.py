"""Adapter from the driver's TPC-H-style Parquet tables to the logical sales model.

The same mapping is written once more as SQL (``STANDIN_SQL``) so an independent engine can
run the oracle queries over the raw tables. Keep the two in step.

Fixed mapping (these choices define the test data; they are not tunable):

* orders          <- orders: o_orderkey, o_custkey, o_orderstatus ('F' is the delivered status),
                     o_orderdate
* order_items     <- lineitem: price = l_extendedprice as DECIMAL(12,2);
                     freight = price * l_tax (DECIMAL(4,2)) as DECIMAL(16,4)
* order_payments  <- orders: o_orderpriority is the payment type, o_totalprice the value
* order_reviews   <- events: order = event_id + 1 when event_id % 5 = 0 else event_id
                     (so orders get 0, 1 or 2 reviews); score = 1 + floor(value) % 5
* customers       <- customer joined to nation: state = n_name, city = c_mktsegment
* products        <- part: category key = p_brand, NULL when p_size = 50
* category_translation <- distinct p_brand with number <= 20 -> 'Category <n>'
                     (brands 21..25 have no translation and fall back to the raw key)
* sellers         <- supplier;  geolocation <- nation joined to region (audit only)
* purchase_times  <- events: event_id, ts (order dates carry no time of day)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.model import SalesModel

DELIVERED_STATUS = "F"

# Schemas of the driver's Parquet tables. Declaring them skips Spark's schema
# inference (one footer-reading job per table) and keeps model construction lazy.
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}
RAW_TABLES = tuple(RAW_SCHEMAS)


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def standin_model(spark: SparkSession, sf_dir: str) -> SalesModel:
    """The logical model over the raw tables; each table is built on first use."""
    cache: dict[str, DataFrame] = {}

    def raw(name: str) -> DataFrame:
        if name not in cache:
            cache[name] = read_raw(spark, sf_dir, name)
        return cache[name]

    def orders() -> DataFrame:
        return raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
        )

    def order_items() -> DataFrame:
        price = F.col("l_extendedprice").cast("decimal(12,2)")
        return raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            price.alias("price"),
            (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(16,4)").alias("freight_value"),
        )

    def order_payments() -> DataFrame:
        return raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderpriority").alias("payment_type"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("payment_value"),
        )

    def order_reviews() -> DataFrame:
        return raw("events").select(
            F.when(F.col("event_id") % 5 == 0, F.col("event_id") + 1)
            .otherwise(F.col("event_id")).alias("order_id"),
            (F.lit(1) + F.floor("value").cast("int") % 5).alias("review_score"),
        )

    def customers() -> DataFrame:
        c, n = raw("customer"), raw("nation")
        return c.join(n, c["c_nationkey"] == n["n_nationkey"], "inner").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("n_name").alias("customer_state"),
            F.col("c_mktsegment").alias("customer_city"),
        )

    def products() -> DataFrame:
        return raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.when(F.col("p_size") == 50, F.lit(None).cast("string"))
            .otherwise(F.col("p_brand")).alias("product_category_name"),
        )

    def category_translation() -> DataFrame:
        brand_no = F.substring("p_brand", 7, 100)
        return raw("part").filter(brand_no.cast("int") <= 20).select(
            F.col("p_brand").alias("product_category_name"),
            F.concat(F.lit("Category "), brand_no).alias("product_category_name_english"),
        ).distinct()

    def geolocation() -> DataFrame:
        n, r = raw("nation"), raw("region")
        return n.join(r, n["n_regionkey"] == r["r_regionkey"]) \
            .select("n_nationkey", "n_name", "n_regionkey", "r_name")

    def purchase_times() -> DataFrame:
        return raw("events").select(
            F.col("event_id").alias("order_id"),
            F.col("ts").alias("order_purchase_timestamp"),
        )

    return SalesModel(
        delivered=DELIVERED_STATUS,
        orders=orders, order_items=order_items, order_payments=order_payments,
        order_reviews=order_reviews, customers=customers, products=products,
        category_translation=category_translation, sellers=lambda: raw("supplier"),
        geolocation=geolocation, purchase_times=purchase_times,
    )


# The same mapping as SQL common table expressions over the raw tables (DuckDB dialect).
STANDIN_SQL = """WITH
sales_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
         o_orderdate AS order_purchase_timestamp
  FROM orders),
sales_items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(16,4))
           AS freight_value
  FROM lineitem),
sales_payments AS (
  SELECT o_orderkey AS order_id, o_orderpriority AS payment_type,
         CAST(o_totalprice AS DECIMAL(12,2)) AS payment_value
  FROM orders),
sales_reviews AS (
  SELECT CASE WHEN event_id % 5 = 0 THEN event_id + 1 ELSE event_id END AS order_id,
         1 + CAST(floor(value) AS INTEGER) % 5 AS review_score
  FROM events),
sales_customers AS (
  SELECT c_custkey AS customer_id, n_name AS customer_state, c_mktsegment AS customer_city
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
sales_products AS (
  SELECT p_partkey AS product_id,
         CASE WHEN p_size = 50 THEN NULL ELSE p_brand END AS product_category_name
  FROM part),
sales_translation AS (
  SELECT DISTINCT p_brand AS product_category_name,
         'Category ' || substr(p_brand, 7) AS product_category_name_english
  FROM part WHERE CAST(substr(p_brand, 7) AS INTEGER) <= 20),
sales_sellers AS (SELECT * FROM supplier),
sales_geolocation AS (
  SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
sales_clock AS (
  SELECT event_id AS order_id, ts AS order_purchase_timestamp FROM events)"""

DELIVERED_SQL = f"'{DELIVERED_STATUS}'"
