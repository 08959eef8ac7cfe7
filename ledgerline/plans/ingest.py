"""Ingest, audit and table write-back jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.functions.calendar import midnight
from ledgerline.model import SalesModel
from ledgerline.plans.clusters import clustered
from ledgerline.plans.forecast import total_forecast
from ledgerline.plans.rfm import positive_base, quantile_scored, rfm_scores_quantile, segment_rollup
from ledgerline.session import cut_lineage, scratch_path
from ledgerline.sources.csv_ingest import ingest_tables, key_audit, row_count_audit, schema_summary
from ledgerline.sources.tables import export_csv, open_table, write_table

__all__ = ["row_count_audit", "schema_summary", "key_audit", "ingest_roundtrip", "save_forecast",
           "save_rfm_scores", "save_rfm_segments", "rfm_segment_rollup_saved", "segment_panel"]


def ingest_roundtrip(model: SalesModel) -> DataFrame:
    """Export every logical table as headed CSV to the shared folder, ingest the files back as
    typed Parquet tables and return the audit of what was written: per column the row count, the NULL
    count and the exact money sum (exercises the CSV ingest path on data that grows with the model)."""
    spark = model.spark
    src, dst = scratch_path(spark, "csv-export"), scratch_path(spark, "ingested")
    files = {}
    for name, df in model.tables().items():
        export_csv(df, f"{src}/{name}.csv")
        files[name] = f"{name}.csv"
    return ingest_tables(spark, src, dst, files)


def save_forecast(model: SalesModel, root: str | None = None, method: str = "moving_average") -> DataFrame:
    """Replace ``revenue_forecast`` (ds, yhat, yhat_lower, yhat_upper) and reopen it."""
    fc = total_forecast(model, method=method)
    return write_table(fc.select(midnight("ds").alias("ds"), "yhat", "yhat_lower", "yhat_upper"), "revenue_forecast", root)


def save_rfm_scores(model: SalesModel, root: str | None = None) -> DataFrame:
    """Replace ``rfm_scores`` (quantile scores and segment label) and reopen it."""
    return write_table(rfm_scores_quantile(model), "rfm_scores", root)


def rfm_segment_rollup_saved(model: SalesModel) -> DataFrame:
    """The dashboard panel over the saved scores: written once, then only read."""
    return segment_panel(save_rfm_scores(model).sparkSession)


def segment_panel(spark: SparkSession, root: str | None = None) -> DataFrame:
    """The segment rollup of the saved ``rfm_scores`` table; reads that table and nothing else."""
    return segment_rollup(open_table(spark, "rfm_scores", root))


def save_rfm_segments(model: SalesModel, root: str | None = None, k: int = 4,
                      n_init: int = 10) -> DataFrame:
    """Replace ``rfm_segments`` (quantile scores, segment label and K-Means cluster) and reopen it."""
    base = cut_lineage(positive_base(model), "rfm-base")  # shared by scores and features
    scored = quantile_scored(model, base)
    clusters = clustered(model, k, n_init, base).select("customer_id", "cluster")
    table = scored.join(clusters, on="customer_id", how="inner").select(
        "customer_id", "recency", "frequency", scored["monetary"].cast("double").alias("monetary"),
        "r_score", "f_score", "m_score", "rfm_score", "segment", "cluster")
    return write_table(table, "rfm_segments", root)
