"""SalesModel: tables are built on first use, once; required tables are enforced."""

import pytest

from ledgerline.model import LOGICAL_TABLES, SalesModel


def test_tables_are_lazy_and_built_once(spark):
    calls = []

    def factory(name):
        def build():
            calls.append(name)
            return spark.createDataFrame([(1,)], "x int")
        return build

    model = SalesModel(**{t: factory(t) for t in LOGICAL_TABLES})
    assert calls == []
    model.orders, model.orders, model.customers
    assert calls == ["orders", "customers"]
    assert model.purchase_times is None and model.clock is model.orders
    copy = model.replace(delivered="F")
    copy.orders
    assert calls == ["orders", "customers"] and copy.delivered == "F"


def test_missing_and_unknown_tables_are_rejected(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(TypeError):
        SalesModel(orders=df)
    with pytest.raises(TypeError):
        SalesModel(**{t: df for t in LOGICAL_TABLES}, invoices=df)


def test_customer_key_is_a_choice(spark):
    """Two customer ids of one person: frequency 2 and one cohort row per person."""
    from ledgerline.plans import cohorts, regional, rfm
    from tests.helpers import simple_model
    model = simple_model(spark, [("o1", "c1", "delivered", "2020-01-05"), ("o2", "c2", "delivered", "2020-03-05"), ("o3", "c3", "delivered", "2020-01-09")],
                         [("o1", "p", 10, 1), ("o2", "p", 20, 1), ("o3", "p", 5, 1)], customers=[("c1", "SP", "a"), ("c2", "RJ", "b"), ("c3", "SP", "c")])
    people = spark.createDataFrame([("c1", "SP", "a", "ann"), ("c2", "RJ", "b", "ann"), ("c3", "SP", "c", "bob")],
                                   "customer_id string, customer_state string, customer_city string, person string")
    keyed = model.with_tables(customers=people).keyed_by("person")
    assert {r.customer_id: r.frequency for r in rfm.rfm_base(keyed).collect()} == {"ann": 2, "bob": 1}
    assert {(r.customer_id, r.month_number) for r in cohorts.cohort_activity(keyed).collect()} == {("ann", 0), ("ann", 2), ("bob", 0)}
    assert {r.state: r.unique_customers for r in regional.state_revenue(keyed).collect()} == {"SP": 2}


def test_sums_of_an_order_never_wrap(spark):
    """Amounts of 14 digits: 46,000 items of an order pass 64 bits; an error with and without ANSI arithmetic."""
    from decimal import Decimal

    import pytest
    from pyspark.sql import functions as F

    from ledgerline.operators.facts import order_totals
    money = F.lit(Decimal("999999999999.99")).cast("decimal(14,2)")
    items = lambda n: spark.range(n).select(F.lit("o").alias("order_id"), money.alias("price"), money.alias("freight_value"))
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            with pytest.raises(Exception):
                order_totals(items(60_000)).collect()
            assert order_totals(items(1000)).first()["gross"] == Decimal("1999999999999.98") * 1000
            none = items(2).withColumns({"price": F.lit(None).cast("decimal(14,2)"), "freight_value": F.lit(None).cast("decimal(14,2)")})
            assert order_totals(none).first()["gross"] is None
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
