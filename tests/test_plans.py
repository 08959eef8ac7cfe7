"""Physical-plan properties the jobs rely on at scale, read from ``explain('formatted')``."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from ledgerline.functions.filters import SalesFilter
from ledgerline.operators.ranking import global_rank
from ledgerline.plans import dashboard, kpis, regional
from pyspark.sql import functions as F
from tests.conftest import SF_SMALL


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_status_filter_and_pruning_reach_the_scan(model_small):
    plan = plan_of(kpis.kpi_overall(model_small))
    assert "EqualTo(o_orderstatus,F)" in plan
    # lineitem is read for key, price and tax only
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_tax:double>" in plan


def test_dashboard_date_range_is_pushed(model_small):
    flt = SalesFilter("1996-01-01", "1997-12-31")
    plan = plan_of(dashboard.monthly_revenue_filtered(model_small, flt))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in plan
    assert "LessThan(o_orderdate,1998-01-01T00:00)" in plan


@pytest.mark.parametrize("job", [regional.state_revenue, regional.top_cities, kpis.kpi_overall])
def test_no_distinct_expansion_over_items(model_small, job):
    plan = plan_of(job(model_small))
    assert "Expand" not in plan


def test_rank_has_no_single_partition_window_over_rows(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("cid"), (F.col("id") % 3).alias("v"))
    plan = plan_of(global_rank(df, [F.col("v"), F.col("cid")], rank_col="r"))
    # the only window is over the per-partition count table, which is broadcast back
    assert "BroadcastExchange" in plan or "BroadcastHashJoin" in plan
    assert "row_number" not in plan


def test_rows_only_jobs_run(spark):
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in ("seasonal_forecast", "seasonality_weekly", "cluster_profiles", "cluster_pca"):
        assert name not in oracle
        rows = queries[name](spark, SF_SMALL).collect()
        assert len(rows) > 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["category", "orders", "revenue", "avg_price", "revenue_pct"]
    assert 0 < df.count() <= 15


def test_filters_reach_the_items_before_they_are_aggregated(model_small):
    flt = SalesFilter("1997-01-01", "1997-01-31", ("NATION_1",))
    for job in (dashboard.state_revenue_filtered, dashboard.kpi_cards, dashboard.monthly_revenue_filtered):
        plan = job(model_small, flt)._jdf.queryExecution().optimizedPlan().toString()
        items = plan[plan.index("l_orderkey"):] if "l_orderkey" in plan else ""
        lines = plan.splitlines()
        scan = next(k for k, x in enumerate(lines) if "l_extendedprice" in x and "Relation" in x)
        above = lines[:scan]
        semi = max(k for k, x in enumerate(above) if "LeftSemi" in x)
        agg = max(k for k, x in enumerate(above) if "Aggregate [" in x and "l_orderkey" in x or "Aggregate [order_id" in x)
        assert agg < semi, plan  # the semi join stands below the per-order aggregate
        assert items


def test_customers_are_scanned_once(model_small):
    flt = SalesFilter("1997-01-01", "1997-01-31", ("NATION_1",))
    plan = dashboard.state_revenue_filtered(model_small, flt)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("c_nationkey:int,c_mktsegment") <= 1


def test_dates_are_read_whole():
    with pytest.raises(ValueError):
        SalesFilter("1997-01-01 and more").date_predicate()
