"""Planted-structure tests for the rows-only jobs (forecast, clustering) and the ingest path."""

import contextlib
import datetime as dt
import io
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.filters import SalesFilter
from ledgerline.plans import clusters, dashboard, forecast
from ledgerline.sources.csv_ingest import ingest_tables, load_model, read_csv_tables
from ledgerline.sources.tables import export_csv

WEEKDAY_EFFECT = [-60.0, 80.0, 40.0, 0.0, 10.0, 20.0, -90.0]  # Sunday first


def _planted_series(spark, days=1100):
    base = spark.range(0, days).select(
        F.col("id"), F.date_add(F.lit("2015-01-04").cast("date"), F.col("id").cast("int")).alias("ds"))
    keys = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 0.5)], "series_key string, mult double")
    eff = F.element_at(F.array(*[F.lit(v) for v in WEEKDAY_EFFECT]), F.dayofweek("ds"))
    y = F.lit(1000.0) + F.col("id") * 0.5 * F.col("mult") + eff * F.col("mult") + F.randn(7) * 5
    return base.crossJoin(keys).select("series_key", "ds", y.cast("decimal(18,2)").alias("y"))


def test_seasonal_model_recovers_weekly_effects(spark):
    series = _planted_series(spark)
    fit = forecast.fit_seasonal(series)
    mean_eff = sum(WEEKDAY_EFFECT) / 7
    mult = {"a": 1.0, "b": 2.0, "c": 0.5}
    for r in forecast.weekly_effects(fit).collect():
        expected = (WEEKDAY_EFFECT[r.day_num] - mean_eff) * mult[r.series_key]
        assert abs(r.effect - expected) < 3.0, (r, expected)


def test_seasonal_forecast_shape_and_band(spark):
    series = _planted_series(spark, days=400)
    out = forecast.seasonal_forecast_of(series, periods=90)
    assert out.count() == 3 * (400 + 90)
    bad = out.filter(~((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))))
    assert bad.count() == 0
    # trend continues: last forecast day near the planted line
    last = out.filter(F.col("series_key") == "a").orderBy(F.desc("ds")).first()
    assert abs(last.trend - (1000 + 0.5 * 489)) < 30


def test_kmeans_recovers_planted_blobs(spark):
    import random
    rng = random.Random(3)
    centres = [(-5, -5, -5), (5, 5, -5), (-5, 5, 5), (5, -5, 5)]
    rows = []
    for c, (x, y, z) in enumerate(centres):
        for i in range(60):
            rows.append((f"{c}-{i}", c, x + rng.gauss(0, .5), y + rng.gauss(0, .5), z + rng.gauss(0, .5)))
    df = spark.createDataFrame(rows, "customer_id string, truth int, z_recency double, "
                                     "z_frequency double, z_monetary double")
    from pyspark.ml.feature import VectorAssembler
    data = VectorAssembler(inputCols=list(clusters.FEATURES), outputCol="features").transform(df)
    got = clusters.assign_clusters(data, k=4, n_init=3).select("truth", "cluster").distinct().collect()
    assert len(got) == 4 and len({r.cluster for r in got}) == 4


def test_ingest_reports_every_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError) as err:
        read_csv_tables(spark, str(tmp_path), {"orders": "a.csv", "customers": "b.csv"})
    assert "a.csv" in str(err.value) and "b.csv" in str(err.value)


def test_ingest_keeps_every_value(spark, model_small, tmp_path):
    src, dst = str(tmp_path / "csv"), str(tmp_path / "tables")
    files = {}
    for name in ("orders", "order_items"):
        export_csv(model_small.table(name), f"{src}/{name}.csv")
        files[name] = f"{name}.csv"
    audit = {(r.tbl, r.col): r for r in ingest_tables(spark, src, dst, files).collect()}
    assert audit["orders", "order_id"].rows == model_small.orders.count()
    items = spark.read.parquet(f"{dst}/order_items")
    assert dict(items.dtypes)["price"] == "decimal(12,2)" and dict(items.dtypes)["freight_value"].endswith(",4)")
    total = model_small.order_items.agg(F.sum("freight_value")).first()[0]
    assert items.agg(F.sum("freight_value")).first()[0] == total
    assert audit["order_items", "freight_value"].total == str(total)
    orders = spark.read.parquet(f"{dst}/orders")
    assert dict(orders.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    assert orders.filter(F.col("order_purchase_timestamp").isNull()).count() == 0


def test_ingest_stops_at_a_bad_value(spark, tmp_path):
    (tmp_path / "items.csv").write_text("order_id,product_id,price,freight_value\no1,p1,10.50,1.25\no2,p2,1o.50,2\no3,p3,,3.123\n")
    files = {"order_items": "items.csv"}
    with pytest.raises(ValueError, match="price 1"):
        read_csv_tables(spark, str(tmp_path), files)
    kept = read_csv_tables(spark, str(tmp_path), files, rejects=str(tmp_path / "rejects"))["order_items"]
    assert [(r.order_id, str(r.price), str(r.freight_value)) for r in kept.collect()] == [("o1", "10.50", "1.250"), ("o3", "None", "3.123")]
    assert [r.order_id for r in spark.read.parquet(str(tmp_path / "rejects/order_items")).collect()] == ["o2"]


def test_ingest_types_the_rest_on_request(spark, tmp_path):
    (tmp_path / "sellers.csv").write_text("seller_id,zip,score\ns1,10,1.5\ns2,20,2\n")
    read = lambda **k: dict(read_csv_tables(spark, str(tmp_path), {"sellers": "sellers.csv"}, **k)["sellers"].dtypes)
    assert read() == {"seller_id": "string", "zip": "string", "score": "string"}
    assert read(infer=True) == {"seller_id": "string", "zip": "int", "score": "double"}


def test_items_are_stored_by_month(spark, model_small, tmp_path):
    src, dst = str(tmp_path / "csv"), str(tmp_path / "tables")
    files = {}
    for name, df in model_small.tables().items():
        export_csv(df.limit(2000) if name == "order_items" else df, f"{src}/{name}.csv")
        files[name] = f"{name}.csv"
    ingest_tables(spark, src, dst, files, orders_by_month=True)
    model = load_model(spark, dst, delivered=model_small.delivered)
    assert model.order_items.count() == 2000
    flt = SalesFilter("1997-01-01", "1997-02-28")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        dashboard.monthly_revenue_filtered(model, flt).explain("formatted")
    assert buf.getvalue().count("PartitionFilters: [isnotnull(order_month") >= 2  # orders and items


def _short(spark, n, y):
    return spark.createDataFrame([("s", dt.date(2020, 1, 1) + dt.timedelta(days=k), Decimal(str(round(y(k), 2)))) for k in range(n)],
                                 "series_key string, ds date, y decimal(18,2)")


@pytest.mark.parametrize("n", [1, 20, 60, 200, 500])
@pytest.mark.parametrize("slope", [0.0, 0.1])
def test_calm_and_short_series(spark, n, slope):
    """Constant and linear series go on as they are, inside a band of positive width."""
    rows = forecast.seasonal_forecast_of(_short(spark, n, lambda k: 100 + slope * k), periods=90).collect()
    assert len(rows) == n + 90
    for r in rows:
        day = (r.ds.date() - dt.date(2020, 1, 1)).days
        near = 100 + slope * (day if n >= forecast.MIN_ROWS_SLOPE else 0)
        assert abs(r.yhat - near) < 3, (n, slope, r)
        assert r.yhat_lower < r.yhat < r.yhat_upper


def test_seasonal_summary_and_method_choice(spark, model_small):
    row = forecast.forecast_summary(model_small, method="seasonal").first()
    assert row.forecast_total > 0 and row.peak_value >= row.forecast_daily_mean
    both = forecast.actual_vs_forecast(model_small, method="seasonal")
    assert both.filter("forecast is not null and actual is not null").count() == 0
    assert both.filter("forecast is not null").count() == 90
    with pytest.raises(ValueError):
        forecast.forecast_summary(model_small, method="other")


def test_clusters_do_not_depend_on_the_shuffle_width(spark, model_small):
    found = []
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for width in ("4", "19"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            found.append(sorted(map(tuple, clusters.cluster_customers(model_small, n_init=2).select("customer_id", "cluster").collect())))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0] == found[1]


def test_customers_sit_at_their_nearest_centre(spark, model_small):
    data = clusters.feature_vectors(model_small)
    rows = clusters.assign_clusters(data, 4, 2).select("features", "cluster").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.cluster, []).append(r.features.toArray())
    centres = {c: sum(v) / len(v) for c, v in groups.items()}
    gap = lambda x, c: ((x - centres[c]) ** 2).sum()
    worse = sum(gap(r.features.toArray(), r.cluster) > min(gap(r.features.toArray(), c) for c in centres) + 0.05 for r in rows)
    assert worse <= 0.01 * len(rows)


def test_named_tables(spark, tmp_path):
    from ledgerline.sources import tables
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        tables.open_table(spark, "t", root)
    tables.write_table(spark.range(3), "t", root)
    old = tables.open_table(spark, "t", root)
    new = tables.write_table(old.unionByName(spark.range(10, 12)), "t", root)  # replaced by a plan that reads it
    assert new.count() == 5 and old.count() == 3
    other = spark.newSession()
    assert sorted(r.id for r in tables.open_table(other, "t", root).collect()) == [0, 1, 2, 10, 11]
    with pytest.raises(Exception):
        tables.write_table(spark.range(2).select(F.raise_error(F.lit("no"))), "t", root)
    assert tables.open_table(spark, "t", root).count() == 5
    tables.write_table(spark.range(1), "t", root)
    assert len(list(tmp_path.glob("t/v-*"))) == 2  # the current one and the one before


def test_segment_panel_only_reads(spark, model_small, tmp_path):
    from ledgerline.plans import ingest
    ingest.save_rfm_scores(model_small, str(tmp_path))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        ingest.segment_panel(spark, str(tmp_path)).explain("formatted")
    assert "rfm_scores" in buf.getvalue() and "lineitem" not in buf.getvalue()


def test_daily_series_many_keys(spark, model_small):
    per_state = forecast.daily_series(model_small, by="customer_state")
    total = forecast.daily_series(model_small)
    states = per_state.select("series_key").distinct().count()
    assert states == model_small.customers.select("customer_state").distinct().count()
    # per-state days add up to the total per day (each side rounded to cents once)
    summed = per_state.groupBy("ds").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("k"))
    off = summed.join(total.select("ds", F.col("y").alias("t")), "ds") \
        .filter(F.abs(F.col("y") - F.col("t")) > F.col("k") * 0.005 + 0.005)
    assert off.count() == 0
    ma = forecast.moving_average_from_series(per_state, periods=7)
    assert ma.select("series_key").distinct().count() == states


def test_daily_series_by_category_adds_up(spark, model_small):
    per_cat = forecast.daily_series(model_small, by="category")
    total = forecast.daily_series(model_small)
    summed = per_cat.groupBy("ds").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("k"))
    off = summed.join(total.select("ds", F.col("y").alias("t")), "ds") \
        .filter(F.abs(F.col("y") - F.col("t")) > F.col("k") * 0.005 + 0.005)
    assert off.count() == 0
    assert summed.count() == total.count()


def test_many_series_forecast_runs(spark, model_small):
    out = forecast.seasonal_forecast_by_state(model_small, periods=10)
    states = model_small.customers.select("customer_state").distinct().count()
    assert out.select("series_key").distinct().count() == states


def test_csv_quoting_and_multiline_reviews(spark, tmp_path):
    reviews = tmp_path / "reviews.csv"
    reviews.write_text('review_id,order_id,review_score,review_comment_message\n'
                       'r1,o1,5,"great, fast"\n'
                       'r2,o2,1,"said ""never again""\nsecond line"\n'
                       'r3,o3,4,\n')
    orders = tmp_path / "orders.csv"
    orders.write_text('order_id,customer_id,order_status,order_purchase_timestamp\n'
                      'o1,c1,delivered,2017-10-02 10:56:33\n'
                      'o2,c2,"shipped",\n')
    frames = read_csv_tables(spark, str(tmp_path), {"order_reviews": "reviews.csv",
                                                    "orders": "orders.csv"})
    rv = {r.review_id: r for r in frames["order_reviews"].collect()}
    assert len(rv) == 3 and rv["r2"].review_comment_message == 'said "never again"\nsecond line'
    assert rv["r2"].review_score == 1 and rv["r3"].review_comment_message is None
    od = {r.order_id: r for r in frames["orders"].collect()}
    assert str(od["o1"].order_purchase_timestamp) == "2017-10-02 10:56:33"
    assert od["o2"].order_purchase_timestamp is None and od["o2"].order_status == "shipped"


def test_csv_header_byte_order_mark(spark, tmp_path):
    f = tmp_path / "translation.csv"
    f.write_bytes("\ufeffproduct_category_name,product_category_name_english\nbeleza,health_beauty\n"
                  .encode("utf-8"))
    df = read_csv_tables(spark, str(tmp_path), {"category_translation": "translation.csv"})
    assert df["category_translation"].columns == ["product_category_name",
                                                  "product_category_name_english"]
