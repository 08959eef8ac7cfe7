"""Recency / frequency / monetary scoring and segment labels.

Two scorings exist and are kept apart because they disagree on ties:

* NTILE scoring (SQL flavour): r = 6 - NTILE(5) by recency, f and m = NTILE(5); ties are split,
  deterministically by ``customer_id``.
* Quantile scoring (pandas ``qcut`` flavour): r and m by linear-interpolation quintile edges,
  right-closed bins, equal values share a bin, repeated edges are an error; f by quintile of the
  first-come rank of frequency (tie-break ``customer_id``).

Both run on :mod:`ledgerline.operators.ranking`, never on a single-partition window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.calendar import days_between
from ledgerline.functions.money import money_out, money_round, round_ratio
from ledgerline.model import SalesModel
from ledgerline.operators.facts import TS, customer_totals, delivered_order_totals
from ledgerline.operators.ranking import (
    QUINTILES, at_or_above, count_edges_below, interpolated, quantile_ranks, require_unique_edges,
    rows_at_ranks, tile_starts,
)
from ledgerline.session import cut_lineage

CANT_LOSE_SQL = "Cant Lose Them"
CANT_LOSE_PY = "Can't Lose Them"


def segment_rules(cant_lose_label: str = CANT_LOSE_PY) -> list[tuple[str, Column]]:
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    # Segment labels and their rules, first match wins (scores are 1..5).
    return [
        ("Champions", (r >= 4) & (f >= 4) & (m >= 4)),
        ("Loyal Customers", (r >= 3) & (f >= 3) & (m >= 3)),
        ("New Customers", (r >= 4) & (f <= 2)),
        ("Potential Loyalists", (r >= 3) & (m >= 3)),
        ("At Risk", (r <= 2) & (f >= 3) & (m >= 3)),
        (cant_lose_label, (r <= 2) & (f >= 4)),
        ("Lost", (r <= 2) & (f <= 2)),
    ]


DEFAULT_SEGMENT = "Needs Attention"


def segment_label(cant_lose_label: str = CANT_LOSE_PY) -> Column:
    expr = None
    for label, cond in segment_rules(cant_lose_label):
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(DEFAULT_SEGMENT))


def _customer_base(model: SalesModel) -> DataFrame:
    """customer_id, last_order_date, recency (days to the latest purchase over *all* orders),
    frequency (delivered orders with items) and monetary (gross, rounded, DECIMAL)."""
    latest = model.orders.agg(F.max(TS)).scalar()
    cust = customer_totals(delivered_order_totals(model))
    return cust.select(
        "customer_id",
        F.col("last_purchase").alias("last_order_date"),
        days_between(F.col("last_purchase"), latest).alias("recency"),
        F.col("orders").alias("frequency"),
        money_round("gross").alias("monetary"),
    )


def rfm_base(model: SalesModel) -> DataFrame:
    b = _customer_base(model)
    return b.select("customer_id", "last_order_date", F.col("recency").alias("recency_days"),
                    "frequency", money_out("monetary").alias("monetary"))


def rfm_base_positive(model: SalesModel) -> DataFrame:
    b = _customer_base(model).filter(F.col("monetary") > 0)
    return b.select("customer_id", "recency", "frequency", money_out("monetary").alias("monetary"))


# ---------------------------------------------------------------- NTILE scoring (SQL flavour)

def _ntile_scores(model: SalesModel) -> DataFrame:
    """Scores by comparison with the four customers at which the fifths of each measure begin."""
    b = cut_lineage(_customer_base(model).select(
        "customer_id", F.col("recency").alias("recency_days"), "frequency", "monetary"), "rfm-base")
    starts = tile_starts(b.count(), 5)
    found = rows_at_ranks(b, {m: starts for m in ("recency_days", "frequency", "monetary")}, "customer_id")
    fifth = lambda m: (F.lit(1) + at_or_above(b, m, "customer_id", [found[m][r] for r in starts])).cast("bigint")
    return b.select("*", fifth("frequency").alias("f_score"), fifth("monetary").alias("m_score"),
                    (F.lit(6) - fifth("recency_days")).cast("bigint").alias("r_score"))


def rfm_scores_ntile(model: SalesModel) -> DataFrame:
    s = _ntile_scores(model)
    return s.select("customer_id", "recency_days", "frequency", money_out("monetary").alias("monetary"),
                    "r_score", "f_score", "m_score")


def _ntile_labelled(model: SalesModel) -> DataFrame:
    s = _ntile_scores(model)
    return s.withColumn("rfm_total", F.col("r_score") + F.col("f_score") + F.col("m_score")) \
        .withColumn("segment", segment_label(CANT_LOSE_SQL))


def rfm_segments(model: SalesModel) -> DataFrame:
    s = _ntile_labelled(model)
    return s.select("customer_id", "recency_days", "frequency", money_out("monetary").alias("monetary"),
                    "r_score", "f_score", "m_score", "rfm_total", "segment")


def rfm_segment_summary(model: SalesModel) -> DataFrame:
    s = _ntile_labelled(model)
    g = s.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum("recency_days").alias("_r"), F.count("recency_days").alias("_rn"),
        F.sum("frequency").alias("_f"), F.count("frequency").alias("_fn"),
        F.sum("monetary").alias("_m"), F.count("monetary").alias("_mn"),
    )
    return g.select(
        "segment", "customer_count",
        round_ratio("_r", "_rn", 1).alias("avg_recency_days"),
        round_ratio("_f", "_fn", 2).alias("avg_frequency"),
        round_ratio("_m", "_mn", 2).alias("avg_monetary"),
        money_out("_m").alias("total_revenue"),
    ).orderBy(F.desc("total_revenue"), F.asc("segment"))


# ---------------------------------------------------------- quantile scoring (qcut flavour)

def positive_base(model: SalesModel) -> DataFrame:
    """customer_id, recency, frequency, monetary (DECIMAL) for customers with spend > 0."""
    return _customer_base(model).filter(F.col("monetary") > 0) \
        .select("customer_id", "recency", "frequency", "monetary")


def quantile_scored(model: SalesModel, base: DataFrame | None = None, approx: bool = False,
                     accuracy: int = 10000) -> DataFrame:
    """Quantile scores. ``approx=True`` opts in to ``percentile_approx`` edges for recency and
    monetary (one pass, bounded memory, no sort; edges are data values, not interpolated)."""
    b = base if base is not None else cut_lineage(positive_base(model), "rfm-base")
    n = b.count()
    if not n:
        raise ValueError("quantile scoring needs at least one customer")
    probs = [0.0, *QUINTILES, 1.0]
    f_edges = [1 + (n - 1) * p for p in probs]  # quantiles of the ranks 1..n are known
    above = [math.floor(e) + 1 for e in f_edges[1:-1]]  # the first rank beyond each inner edge
    wanted = {"frequency": [r for r in above if r <= n]}
    if not approx:
        wanted |= {"recency": quantile_ranks(n, probs), "monetary": quantile_ranks(n, probs)}
    found = rows_at_ranks(b, wanted, "customer_id")
    if approx:
        row = b.agg(F.percentile_approx(F.col("recency").cast("double"), probs, accuracy).alias("r"),
                    F.percentile_approx(F.col("monetary").cast("double"), probs, accuracy).alias("m")
                    ).first()
        r_edges, m_edges = list(row["r"]), list(row["m"])
    else:
        values = lambda m: {r: float(v) for r, (v, _) in found[m].items()}
        r_edges, m_edges = interpolated(values("recency"), n, probs), interpolated(values("monetary"), n, probs)
    f_score = F.lit(1) + at_or_above(b, "frequency", "customer_id", [found["frequency"][r] for r in wanted["frequency"]])
    for what, e in (("recency", r_edges), ("monetary", m_edges), ("frequency rank", f_edges)):
        require_unique_edges(e, what)
    mon = F.col("monetary").cast("double")
    return b.select(
        "customer_id", "recency", "frequency", "monetary",
        (F.lit(5) - count_edges_below(F.col("recency"), r_edges[1:-1])).cast("bigint").alias("r_score"),
        f_score.cast("bigint").alias("f_score"),
        (F.lit(1) + count_edges_below(mon, m_edges[1:-1])).cast("bigint").alias("m_score"),
    ).withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score")) \
     .withColumn("segment", segment_label(CANT_LOSE_PY))


def rfm_scores_quantile(model: SalesModel) -> DataFrame:
    s = quantile_scored(model)
    return s.select("customer_id", "recency", "frequency", money_out("monetary").alias("monetary"),
                    "r_score", "f_score", "m_score", "rfm_score", "segment")


def segment_rollup(scored: DataFrame) -> DataFrame:
    """Per segment: customers, mean and total monetary. Works on a saved ``rfm_segments`` table
    too, where monetary is a cents-valued DOUBLE: it is summed as DECIMAL either way."""
    mon = F.col("monetary").cast("decimal(38,2)")
    g = scored.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(mon).alias("_m"), F.count(mon).alias("_mn"),
    )
    return g.select("segment", "customers",
                    round_ratio("_m", "_mn", 2).alias("avg_value"),
                    F.round(F.col("_m"), 2).cast("double").alias("total_revenue")) \
        .orderBy(F.desc("total_revenue"), F.asc("segment"))


def rfm_segment_rollup(model: SalesModel) -> DataFrame:
    return segment_rollup(quantile_scored(model))
