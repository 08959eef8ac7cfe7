"""Hand-made edge cases (FIXTURES.md section 3) and known values on the sf0.01 stand-in."""

import itertools

from pyspark.sql import functions as F

from ledgerline.functions.calendar import (
    days_between, month_name, months_between_starts, weekday_name, weekday_number,
)
from ledgerline.functions.filters import SalesFilter
from ledgerline.plans import dashboard, forecast, kpis, regional, rfm
from tests.helpers import simple_model, ts


def test_calendar_semantics(spark):
    df = spark.createDataFrame([(ts("2017-11-24 10:00:00"), ts("2017-01-31 23:59:00"),
                                 ts("2017-02-01 00:01:00"), ts("2017-01-31 23:00:00"),
                                 ts("2017-02-01 01:00:00"))],
                               "a timestamp_ntz, b timestamp_ntz, c timestamp_ntz, "
                               "d timestamp_ntz, e timestamp_ntz")
    r = df.select(weekday_name("a").alias("wd"), weekday_number("a").alias("wn"),
                  month_name("a").alias("mn"),
                  months_between_starts("b", "c").alias("months"),
                  days_between("d", "e").alias("days")).first()
    assert (r.wd, r.wn, r.mn, r.months, r.days) == ("Friday", 5, "November", 1, 1)


def test_category_fallback(spark):
    m = simple_model(
        spark,
        orders=[("o1", "c1", "delivered", "2018-01-01 10:00:00")],
        items=[("o1", "p1", 10, 0), ("o1", "p2", 20, 0), ("o1", "p3", 30, 0)],
        products=[("p1", "beleza"), ("p2", "relogios"), ("p3", None)],
        translation=[("beleza", "health_beauty")],
    )
    got = {r.category: r.revenue for r in kpis.category_revenue(m).collect()}
    assert got == {"health_beauty": 10.0, "relogios": 20.0, "Unknown": 30.0}
    peak = {r.category for r in kpis.category_revenue(m).collect()}
    assert "Unknown" in peak
    from ledgerline.plans.seasonal import peak_month_by_category
    cats = {r.category for r in peak_month_by_category(m).collect()}
    assert cats == {"health_beauty", "relogios", None}


def test_review_fanout_and_dedup(spark):
    m = simple_model(
        spark,
        orders=[("o1", "c1", "delivered", "2018-01-01 10:00:00")],
        items=[("o1", "p1", 10, 0), ("o1", "p2", 20, 0)],
        reviews=[("o1", 5), ("o1", 1)],
    )
    fan = dashboard.kpi_cards(m).first()
    dedup = dashboard.kpi_cards_dedup(m).first()
    assert (fan.revenue, fan.avg_rating, fan.orders) == (60.0, 3.0, 1)
    assert (dedup.revenue, dedup.avg_rating, dedup.orders) == (30.0, 3.0, 1)


def test_zero_price_state_gives_null_freight_pct(spark):
    m = simple_model(
        spark,
        orders=[("o1", "c1", "delivered", "2018-01-01 10:00:00"),
                ("o2", "c2", "delivered", "2018-01-02 10:00:00")],
        items=[("o1", "p1", 0, 0), ("o2", "p1", 10, 2)],
        customers=[("c1", "AC", "x"), ("c2", "SP", "y")],
    )
    got = {r.state: r.freight_pct for r in regional.state_revenue(m).collect()}
    assert got["AC"] is None and got["SP"] == round(2 / 12 * 100, 2)
    ratio = {r.state: r.freight_to_price_ratio_pct for r in regional.freight_burden(m).collect()}
    assert ratio["AC"] is None and ratio["SP"] == 20.0


def test_empty_filter_equals_unfiltered(spark, model_small):
    a = dashboard.kpi_cards(model_small, SalesFilter()).first()
    b = dashboard.kpi_cards(model_small, SalesFilter(states=("All",))).first()
    c = dashboard.kpi_cards(model_small, SalesFilter(states=())).first()
    assert a == b == c


def test_top1_tie_takes_alphabetically_first_month(spark):
    m = simple_model(
        spark,
        orders=[("o1", "c1", "delivered", "2018-03-05 10:00:00"),
                ("o2", "c1", "delivered", "2018-01-05 10:00:00")],
        items=[("o1", "p1", 10, 0), ("o2", "p1", 10, 0)],
    )
    from ledgerline.plans.seasonal import peak_month_by_category
    r = peak_month_by_category(m).first()
    assert (r.peak_month, r.revenue) == ("January", 10.0)


def test_share_is_taken_before_limit(spark):
    orders = [(f"o{i}", "c1", "delivered", "2018-01-01 10:00:00") for i in range(16)]
    items = [(f"o{i}", f"p{i}", 10, 0) for i in range(16)]
    rows = kpis.category_revenue(simple_model(spark, orders, items)).collect()
    assert len(rows) == 15
    assert all(r.revenue_pct == 6.25 for r in rows)
    assert sum(r.revenue_pct for r in rows) == 93.75


def test_share_rounding(spark):
    orders = [(f"o{i}", f"c{i}", s, "2018-01-01 10:00:00")
              for i, s in enumerate(["delivered", "shipped", "canceled"])]
    rows = kpis.order_status_breakdown(simple_model(spark, orders, [])).collect()
    assert sorted(r.pct for r in rows) == [33.33, 33.33, 33.33]


def _daily_model(spark, days):
    orders = [(f"o{i}", "c1", "delivered", f"2018-01-01 10:00:00") for i in range(0)]
    import datetime as dt
    base = dt.date(2018, 1, 1)
    orders = [(f"o{i}", "c1", "delivered", f"{base + dt.timedelta(days=i)} 10:00:00") for i in range(days)]
    items = [(f"o{i}", "p1", 100 + i, 0) for i in range(days)]
    return simple_model(spark, orders, items)


def test_moving_average_fallback(spark):
    short = forecast.moving_average_forecast(_daily_model(spark, 29)).collect()
    assert len(short) == 29 + 90
    assert all(r.yhat is None for r in short[29:])
    full = forecast.moving_average_forecast(_daily_model(spark, 30)).collect()
    mean = sum(100 + i for i in range(30)) / 30
    fut = full[30:]
    assert all(abs(r.yhat - mean) < 1e-9 for r in fut)
    assert abs(fut[0].yhat_lower - 0.8 * mean) < 1e-9 and abs(fut[0].yhat_upper - 1.2 * mean) < 1e-9
    assert all(r.yhat_lower is None and r.yhat_upper is None for r in full[:30])


def test_segment_rules_cover_all_triples(spark):
    triples = list(itertools.product(range(1, 6), repeat=3))
    df = spark.createDataFrame(triples, "r_score int, f_score int, m_score int")
    labels = df.select(rfm.segment_label().alias("s")).collect()
    assert len(labels) == 125 and all(r.s for r in labels)
    assert len({r.s for r in labels}) == 8


def test_zero_monetary_excluded_from_positive_base(spark):
    m = simple_model(
        spark,
        orders=[("o1", "c1", "delivered", "2018-01-01 10:00:00"),
                ("o2", "c2", "delivered", "2018-01-02 10:00:00")],
        items=[("o1", "p1", 0, 0), ("o2", "p1", 10, 0)],
    )
    assert {r.customer_id for r in rfm.rfm_base(m).collect()} == {"c1", "c2"}
    assert {r.customer_id for r in rfm.rfm_base_positive(m).collect()} == {"c2"}


def test_known_values_sf001(model_check):
    k = dashboard.kpi_cards_dedup(model_check).first()
    assert (k.orders, k.customers, k.revenue, k.aov, k.avg_rating) == (
        4859, 1425, 1095638807.65, 55179.23, 2.94)
    seg = {r.segment: r.customer_count for r in rfm.rfm_segment_summary(model_check).collect()}
    assert seg == {"Champions": 263, "Loyal Customers": 274, "New Customers": 146,
                   "Potential Loyalists": 23, "At Risk": 196, "Cant Lose Them": 8,
                   "Lost": 327, "Needs Attention": 188}
    first_future = forecast.moving_average_forecast(model_check).filter(
        F.col("yhat_lower").isNotNull()).orderBy("ds").first()
    assert str(first_future.ds.date()) == "2001-08-01"
    assert abs(first_future.yhat - 583711.7706666667) < 1e-6


def test_calendar_gaps(spark):
    import datetime as dt
    from decimal import Decimal

    import pytest

    from ledgerline.plans import forecast
    day = lambda k: dt.date(2020, 2, 27) + dt.timedelta(days=k)
    rows = [("a", day(0), Decimal("5.00")), ("a", day(3), Decimal("7.50")), ("a", day(4), None), ("b", day(1), Decimal("1.00")), (None, day(2), Decimal("2.00")),
            (None, day(4), Decimal("3.00"))]
    series = spark.createDataFrame(rows, "series_key string, ds date, y decimal(18,2)")
    show = lambda fill: sorted(((r.series_key or "", (r.ds - day(0)).days, float(r.y), r.filled) for r in forecast.on_calendar(series, fill).collect()))
    assert show("zero") == [("", 2, 2.0, False), ("", 3, 0.0, True), ("", 4, 3.0, False), ("a", 0, 5.0, False), ("a", 1, 0.0, True), ("a", 2, 0.0, True),
                            ("a", 3, 7.5, False), ("a", 4, 0.0, True), ("b", 1, 1.0, False)]
    assert show("last") == [("", 2, 2.0, False), ("", 3, 2.0, True), ("", 4, 3.0, False), ("a", 0, 5.0, False), ("a", 1, 5.0, True), ("a", 2, 5.0, True),
                            ("a", 3, 7.5, False), ("a", 4, 7.5, True), ("b", 1, 1.0, False)]
    assert forecast.on_calendar(series) is series
    with pytest.raises(ValueError):
        forecast.on_calendar(series, "mean")
    level = lambda fill: forecast.moving_average_from_series(forecast.on_calendar(series, fill).select("series_key", "ds", "y"), 1, window=3).filter(
        "is_future and series_key = 'a'").first().yhat
    assert level(None) is None and level("zero") == 2.5 and abs(level("last") - 20 / 3) < 1e-9
