"""The logical sales model every job reads.

Tables and columns (names follow the public e-commerce dataset the jobs were designed for):

=====================  ==========================================================================
orders                 order_id, customer_id, order_status, order_purchase_timestamp (timestamp_ntz)
order_items            order_id, product_id, price (decimal), freight_value (decimal)
order_payments         order_id, payment_type, payment_value (decimal)
order_reviews          order_id, review_score (int), 0..n rows per order
customers              customer_id, customer_state, customer_city
products               product_id, product_category_name (nullable)
category_translation   product_category_name, product_category_name_english
sellers, geolocation   any columns; only ingested and audited
purchase_times         order_id, order_purchase_timestamp: the clock used by hour-of-day jobs
                       (defaults to ``orders``; a source may supply a finer-grained clock)
=====================  ==========================================================================

Keys: ``order_id`` is unique in ``orders``; ``customer_id`` in ``customers``; ``product_id`` in
``products``. Money stays DECIMAL inside every job and is cast to DOUBLE only at the output.

Tables are given either as DataFrames or as zero-argument factories; a factory runs on first
use, so a job pays only for the tables it reads (building a DataFrame is analysed eagerly).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The logical table names (the column names above are fixed too).
LOGICAL_TABLES = (
    "orders", "order_items", "order_payments", "order_reviews", "customers",
    "products", "sellers", "category_translation", "geolocation",
)
OPTIONAL_TABLES = ("purchase_times",)

TableSource = DataFrame | Callable[[], DataFrame]


class SalesModel:
    """The nine logical tables (+ optional clock), the delivered status value and extras
    (shared materialisations such as a cached order fact)."""

    def __init__(self, delivered: str = "delivered", extras: dict | None = None,
                 **tables: TableSource | None):
        unknown = set(tables) - set(LOGICAL_TABLES) - set(OPTIONAL_TABLES)
        if unknown:
            raise TypeError(f"unknown tables: {sorted(unknown)}")
        missing = [t for t in LOGICAL_TABLES if tables.get(t) is None]
        if missing:
            raise TypeError(f"missing tables: {missing}")
        self._sources = {k: v for k, v in tables.items() if v is not None}
        self._built: dict[str, DataFrame] = {}
        self.delivered = delivered
        self.extras = dict(extras or {})

    def table(self, name: str) -> DataFrame | None:
        if name not in self._built:
            source = self._sources.get(name)
            if source is None:
                return None
            self._built[name] = source if isinstance(source, DataFrame) else source()
        return self._built[name]

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in LOGICAL_TABLES}

    def replace(self, delivered: str | None = None, extras: dict | None = None,
                **tables: TableSource) -> "SalesModel":
        sources = {**self._sources, **self._built, **tables}
        if extras is None:  # shared results belong to the tables they were made from
            extras = {} if tables or delivered is not None else self.extras
        return SalesModel(delivered=self.delivered if delivered is None else delivered, extras=extras, **sources)

    def with_tables(self, **tables: TableSource) -> "SalesModel":
        return self.replace(**tables)

    def keyed_by(self, column: str) -> "SalesModel":
        """The same sales counted per ``column`` of ``customers`` (a person who has several customer ids, say):
        RFM, cohort and cluster jobs over the result are per value of it. Orders of unknown customers drop out; the place of
        a merged customer is that of its least customer id."""
        own = self.customers.select("customer_id", F.col(column).alias("_key"))
        orders = self.orders.join(own, on="customer_id", how="inner").withColumn("customer_id", F.col("_key")).drop("_key")
        first = self.customers.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key")).agg(
            F.min_by(F.struct(*[F.col(c) for c in self.customers.columns if c != "customer_id"]), "customer_id").alias("_row"))
        return self.with_tables(orders=orders, customers=first.select(F.col("_key").alias("customer_id"), "_row.*"))

    @property
    def spark(self) -> SparkSession:
        return self.orders.sparkSession

    @property
    def clock(self) -> DataFrame:
        return self.purchase_times if self.purchase_times is not None else self.orders

    orders = property(lambda self: self.table("orders"))
    order_items = property(lambda self: self.table("order_items"))
    order_payments = property(lambda self: self.table("order_payments"))
    order_reviews = property(lambda self: self.table("order_reviews"))
    customers = property(lambda self: self.table("customers"))
    products = property(lambda self: self.table("products"))
    sellers = property(lambda self: self.table("sellers"))
    category_translation = property(lambda self: self.table("category_translation"))
    geolocation = property(lambda self: self.table("geolocation"))
    purchase_times = property(lambda self: self.table("purchase_times"))
