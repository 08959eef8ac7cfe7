"""Registered jobs: name -> callable(spark, sf_dir) -> DataFrame over the stand-in model."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ledgerline.model import SalesModel
from ledgerline.plans import cells, clusters, cohorts, dashboard, forecast, ingest, kpis, regional, rfm, seasonal
from ledgerline.sources.standin import standin_model

ModelJob = Callable[[SalesModel], DataFrame]

MODEL_JOBS: dict[str, ModelJob] = {
    # A1 ingest and audit
    "row_count_audit": ingest.row_count_audit,
    "schema_summary": ingest.schema_summary,
    "key_audit": ingest.key_audit,
    "ingest_tables": ingest.ingest_roundtrip,
    "sample_join_top5": kpis.sample_join_top5,
    # A2 KPIs
    "kpi_overall": kpis.kpi_overall,
    "category_revenue": kpis.category_revenue,
    "payment_type_summary": kpis.payment_type_summary,
    "order_status_breakdown": kpis.order_status_breakdown,
    "monthly_running_total": kpis.monthly_running_total,
    "review_score_distribution": kpis.review_score_distribution,
    # A3 regional
    "state_revenue": regional.state_revenue,
    "top_cities": regional.top_cities,
    "freight_burden": regional.freight_burden,
    # A4 seasonal
    "monthly_trend": seasonal.monthly_trend,
    "monthly_gross_trend": seasonal.monthly_gross_trend,
    "revenue_by_dow": seasonal.revenue_by_dow,
    "orders_by_hour": seasonal.orders_by_hour,
    "dow_hour_counts": seasonal.dow_hour_counts,
    "dow_hour_heatmap": seasonal.dow_hour_heatmap,
    "peak_month_by_category": seasonal.peak_month_by_category,
    # A5 cohorts
    "cohort_assignment": cohorts.cohort_assignment,
    "cohort_activity": cohorts.cohort_activity,
    "cohort_sizes": cohorts.cohort_sizes,
    "cohort_retention": cohorts.cohort_retention,
    # A6 RFM
    "rfm_base": rfm.rfm_base,
    "rfm_base_positive": rfm.rfm_base_positive,
    "rfm_scores_ntile": rfm.rfm_scores_ntile,
    "rfm_segments": rfm.rfm_segments,
    "rfm_segment_summary": rfm.rfm_segment_summary,
    "rfm_scores_quantile": rfm.rfm_scores_quantile,
    "rfm_segment_rollup": rfm.rfm_segment_rollup,
    "save_rfm_segments": ingest.save_rfm_segments,
    "rfm_scores_saved": ingest.save_rfm_scores,
    "rfm_segment_rollup_saved": ingest.rfm_segment_rollup_saved,
    # A7 clustering and projection
    "rfm_features": clusters.rfm_features,
    "cluster_customers": clusters.cluster_customers,
    "cluster_sweep": clusters.cluster_sweep,
    "cluster_pca": clusters.cluster_pca,
    "cluster_profiles": clusters.cluster_profiles,
    "cluster_totals": clusters.cluster_totals,
    "feature_variance": clusters.feature_variance,
    # A8 time series and forecast
    "daily_revenue": forecast.daily_revenue,
    "daily_revenue_filled": forecast.daily_revenue_filled,
    "series_span": forecast.series_span,
    "moving_average_forecast": forecast.moving_average_forecast,
    "forecast_summary": forecast.forecast_summary,
    "actual_vs_forecast": forecast.actual_vs_forecast,
    "save_forecast": ingest.save_forecast,
    "seasonal_forecast": forecast.seasonal_forecast,
    "seasonal_forecast_by_state": forecast.seasonal_forecast_by_state,
    "forecast_summary_seasonal": forecast.forecast_summary_seasonal,
    "series_moments": forecast.series_moments,
    "forecast_band_growth": forecast.forecast_band_growth,
    "seasonality_weekly": forecast.seasonality_weekly,
    "seasonality_yearly": forecast.seasonality_yearly,
    # A9 dashboard queries (default filter: whole date range, all states)
    "date_bounds": dashboard.date_bounds,
    "state_list": dashboard.state_list,
    "kpi_cards": dashboard.kpi_cards,
    "kpi_cards_dedup": dashboard.kpi_cards_dedup,
    "kpi_cards_cells": cells.kpi_cards_cells,
    "kpi_cards_cells_year_states": cells.kpi_cards_cells_year_states,
    "monthly_revenue_filtered": dashboard.monthly_revenue_filtered,
    "category_revenue_filtered": dashboard.category_revenue_filtered,
    "state_revenue_filtered": dashboard.state_revenue_filtered,
    "state_revenue_top10": dashboard.state_revenue_top10,
}


# The same dashboard queries with a real date range and state list.
FILTERED_JOBS = ("kpi_cards", "kpi_cards_dedup", "monthly_revenue_filtered", "category_revenue_filtered",
                 "state_revenue_filtered")
for _name in FILTERED_JOBS:
    MODEL_JOBS[f"{_name}_year_states"] = partial(MODEL_JOBS[_name], flt=dashboard.YEAR_AND_STATES)


def _bind(job: ModelJob) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return job(standin_model(spark, sf_dir))
    run.__name__ = getattr(job, "__name__", "job")
    run.__doc__ = job.__doc__
    return run


def registered_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(job) for name, job in MODEL_JOBS.items()}
