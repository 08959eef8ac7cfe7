"""Cached order fact and month-partitioned orders give the same answers as the plain plans."""

import contextlib
import io

from ledgerline.functions.filters import SalesFilter
from ledgerline.model import SalesModel
from ledgerline.operators.facts import release_order_fact, with_cached_order_fact
from ledgerline.plans import dashboard, kpis, regional
from ledgerline.session import scratch_path
from ledgerline.sources.csv_ingest import ingest_tables, load_model
from ledgerline.sources.tables import export_csv

FLT = SalesFilter("1996-02-10", "1999-11-30", ("NATION_2", "NATION_4", "NATION_9"))


def test_cached_fact_same_results(spark, model_small):
    cached = with_cached_order_fact(model_small)
    try:
        for job in (kpis.kpi_overall, regional.state_revenue, dashboard.kpi_cards):
            assert sorted(job(cached).collect()) == sorted(job(model_small).collect())
        for job in (dashboard.kpi_cards_dedup, dashboard.monthly_revenue_filtered,
                    dashboard.state_revenue_filtered):
            assert sorted(job(cached, FLT).collect()) == sorted(job(model_small, FLT).collect())
    finally:
        release_order_fact(cached)


def test_month_partitioned_orders_prune_and_agree(spark, model_small):
    src, dst = scratch_path(spark, "pp-csv"), scratch_path(spark, "pp-tables")
    files = {}
    for name, df in model_small.tables().items():
        export_csv(df, f"{src}/{name}.csv")
        files[name] = f"{name}.csv"
    ingest_tables(spark, src, dst, files, orders_by_month=True)
    loaded = load_model(spark, dst, delivered=model_small.delivered)
    # the stand-in's CSV copy has string keys; compare like with like
    plain_dst = scratch_path(spark, "pp-plain")
    ingest_tables(spark, src, plain_dst, files, orders_by_month=False)
    plain = load_model(spark, plain_dst, delivered=model_small.delivered)
    for job in (dashboard.kpi_cards_dedup, dashboard.monthly_revenue_filtered):
        assert sorted(job(loaded, FLT).collect()) == sorted(job(plain, FLT).collect())
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        dashboard.monthly_revenue_filtered(loaded, FLT).explain("formatted")
    plan = buf.getvalue()
    assert "PartitionFilters: [" in plan and "order_month" in plan
    assert isinstance(loaded, SalesModel)


def test_bucketed_order_tables_skip_the_shuffle(spark, model_small):
    src, dst = scratch_path(spark, "bk-csv"), scratch_path(spark, "bk-tables")
    files = {}
    for name, df in model_small.tables().items():
        export_csv(df, f"{src}/{name}.csv")
        files[name] = f"{name}.csv"
    ingest_tables(spark, src, dst, files, buckets=4, table_prefix="bk_")
    bucketed = load_model(spark, dst, delivered=model_small.delivered, table_prefix="bk_")
    plain_dst = scratch_path(spark, "bk-plain")
    ingest_tables(spark, src, plain_dst, files)
    plain = load_model(spark, plain_dst, delivered=model_small.delivered)
    assert sorted(kpis.kpi_overall(bucketed).collect()) == sorted(kpis.kpi_overall(plain).collect())
    assert sorted(regional.state_revenue(bucketed).collect()) == \
        sorted(regional.state_revenue(plain).collect())
    # items -> order aggregate and the join with orders read co-bucketed files: no exchange on
    # order_id (broadcasts disabled so the planner has to pick a partitioned join)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        from ledgerline.operators.facts import delivered_order_totals
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            delivered_order_totals(bucketed).explain("formatted")
        plan = buf.getvalue()
        assert "hashpartitioning(order_id" not in plan
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
