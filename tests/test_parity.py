"""Every job with oracle SQL agrees with DuckDB on the same Parquet (the correctness gate)."""

import pytest

import __spark_entry__ as entry
from ledgerline.plans.oracle import dashboard_sql
from tests.parity import compare, run_oracle
from ledgerline.plans import dashboard
from ledgerline.functions.filters import SalesFilter
from tests.conftest import SF_CHECK, SF_SMALL

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_job_matches_oracle_small(spark, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = run_oracle(ORACLE[name], SF_SMALL)
    ok, msg = compare(got, want)
    assert ok, msg


CHECK_AT_SF001 = ["kpi_overall", "category_revenue", "state_revenue", "cohort_retention",
                  "rfm_segment_summary", "rfm_scores_quantile", "moving_average_forecast",
                  "kpi_cards", "peak_month_by_category"]


@pytest.mark.parametrize("name", CHECK_AT_SF001)
def test_job_matches_oracle_check_scale(spark, name):
    got = QUERIES[name](spark, SF_CHECK).toPandas()
    want = run_oracle(ORACLE[name], SF_CHECK)
    ok, msg = compare(got, want)
    assert ok, msg


FILTERS = [
    ("1997-01-01", "1999-06-30", ["All"]),
    (None, None, ["NATION_3", "NATION_7", "NATION_11"]),
    ("1996-03-15", "1998-12-31", ["NATION_1", "NATION_20"]),
]


@pytest.mark.parametrize("start,end,states", FILTERS)
@pytest.mark.parametrize("job", ["kpi_cards", "kpi_cards_dedup", "monthly_revenue_filtered",
                                 "category_revenue_filtered", "state_revenue_filtered"])
def test_dashboard_filters_match_oracle(spark, model_check, job, start, end, states):
    flt = SalesFilter(start, end, tuple(states))
    got = getattr(dashboard, job)(model_check, flt).toPandas()
    want = run_oracle(dashboard_sql(start, end, states)[job], SF_CHECK)
    ok, msg = compare(got, want)
    assert ok, msg


@pytest.mark.parametrize("name", ["orders_by_hour", "dow_hour_heatmap", "monthly_trend",
                                  "cohort_retention", "daily_revenue", "date_bounds"])
def test_calendar_jobs_do_not_depend_on_session_time_zone(spark, name):
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        got = QUERIES[name](spark, SF_SMALL).toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ok, msg = compare(got, run_oracle(ORACLE[name], SF_SMALL))
    assert ok, msg
