"""Build tiny logical models by hand for edge-case tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from ledgerline.model import SalesModel

SCHEMAS = {
    "orders": "order_id string, customer_id string, order_status string, "
              "order_purchase_timestamp timestamp_ntz",
    "order_items": "order_id string, product_id string, price decimal(12,2), "
                   "freight_value decimal(12,2)",
    "order_payments": "order_id string, payment_type string, payment_value decimal(12,2)",
    "order_reviews": "order_id string, review_score int",
    "customers": "customer_id string, customer_state string, customer_city string",
    "products": "product_id string, product_category_name string",
    "category_translation": "product_category_name string, product_category_name_english string",
    "sellers": "seller_id string",
    "geolocation": "zip string",
}


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def money(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def make_model(spark, **rows) -> SalesModel:
    frames = {}
    for name, schema in SCHEMAS.items():
        data = rows.get(name, [])
        if name in ("order_items", "order_payments"):
            data = [tuple(money(v) if isinstance(v, (int, float)) and i >= 2 else v
                          for i, v in enumerate(r)) for r in data]
        frames[name] = spark.createDataFrame(data, schema)
    return SalesModel(**frames)


def simple_model(spark, orders, items, customers=None, products=None, translation=None,
                 reviews=None, payments=None) -> SalesModel:
    """orders: (id, customer, status, ts-text); items: (order, product, price, freight)."""
    orders = [(o, c, s, ts(t)) for o, c, s, t in orders]
    customers = customers if customers is not None else sorted(
        {(o[1], "SP", "sao paulo") for o in orders})
    products = products if products is not None else sorted({(i[1], "cat_" + i[1]) for i in items})
    return make_model(spark, orders=orders, order_items=items, customers=customers,
                      products=products, category_translation=translation or [],
                      order_reviews=reviews or [], order_payments=payments or [])
