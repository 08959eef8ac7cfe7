"""Daily revenue series and forecasts, for one or many series at once.

* ``daily_revenue``: gross revenue per day over delivered orders (optionally per series key).
* ``moving_average_forecast``: mean of the last 30 *rows* of each series, carried 90 days ahead
  with a +-20 % band; history rows keep the actual value and have no band; fewer than 30 rows
  gives a NULL forecast.
* ``seasonal_forecast``: additive model -- piecewise-linear trend (25 hinges over the first 80 % of
  the history), yearly (10 harmonics) and weekly (3 harmonics) Fourier terms -- fitted by ridge
  regression with Gaussian priors (changepoints 0.05, seasonality 10) on y scaled by max |y|.
  The heavy part, the Gram matrix [X y]^T [X y], is one distributed aggregation per series
  (MLlib ``Summarizer``); each series then needs only a 54 x 54 solve, done on its single
  aggregated row. Intervals are analytic: yhat +- z * sigma at a stated level (default 80 %), sigma being at least
  0.5 % of the largest value. Series too short for a part of the model go without it (``_left_out``).
  The trend prior is Gaussian rather than Laplace, so results differ from sampling-based tools.

A series is bounded by its calendar span (one row per day), whatever the order volume.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.calendar import day_of, midnight, weekday_name, weekday_number
from ledgerline.functions.money import money_round
from ledgerline.model import SalesModel
from ledgerline.functions.category import product_categories
from ledgerline.operators.facts import TS, delivered_items, delivered_order_totals
from ledgerline.session import cut_lineage

TOTAL_SERIES = "total"
EPOCH = "1970-01-01"


CATEGORY = "category"


def daily_series(model: SalesModel, by: str | Column | None = None) -> DataFrame:
    """(series_key, ds, y) with y the DECIMAL gross revenue rounded to cents. ``by`` is None (one
    total series), ``"category"`` (item grain, label as in the category jobs), a column of the
    order rows (customer_id, ...) or of ``customers`` (customer_state, customer_city)."""
    if isinstance(by, str) and by == CATEGORY:
        items = delivered_items(model, order_columns=(TS,))
        cats = product_categories(model.products, model.category_translation)
        rows = items.join(cats, on="product_id", how="inner")
        return rows.groupBy(F.col(CATEGORY).alias("series_key"), day_of(TS).alias("ds")) \
            .agg(money_round(F.sum(F.col("price") + F.col("freight_value"))).alias("y"))
    rows = delivered_order_totals(model)
    if by is None:
        key = F.lit(TOTAL_SERIES)
    else:
        name = by if isinstance(by, str) else None
        if name is not None and name not in rows.columns:
            place = model.customers.select("customer_id", name)
            rows = rows.join(place, on="customer_id", how="inner")
        key = F.col(by) if isinstance(by, str) else by
    return rows.groupBy(key.cast("string").alias("series_key"), day_of(TS).alias("ds")) \
        .agg(money_round(F.sum("gross")).alias("y"))


def daily_revenue(model: SalesModel) -> DataFrame:
    return daily_series(model).select(midnight("ds").alias("ds"), F.col("y").cast("double").alias("y")) \
        .orderBy("ds")


def series_span(model: SalesModel) -> DataFrame:
    return daily_series(model).agg(
        F.count(F.lit(1)).alias("days"), midnight(F.min("ds")).alias("first_day"),
        midnight(F.max("ds")).alias("last_day"))


FILLS = ("zero", "last")


def on_calendar(series: DataFrame, fill: str | None = None) -> DataFrame:
    """The series with a row for every calendar day from its first to its last one: days without a value (none, or null) get 0
    (``zero``) or the last value before them (``last``), and ``filled`` tells them from the others. Without ``fill`` the series stays as it is."""
    if fill is None:
        return series
    if fill not in FILLS:
        raise ValueError(f"fill must be one of {FILLS}, not {fill!r}")
    spine = series.groupBy(F.col("series_key").alias("_key")).agg(F.min("ds").alias("_first"), F.max("ds").alias("_last")).select(
        "_key", F.explode(F.sequence("_first", "_last")).alias("_day"))
    days = spine.join(series, F.col("_key").eqNullSafe(F.col("series_key")) & (F.col("_day") == F.col("ds")), "left")
    if fill == "zero":
        value = F.coalesce("y", F.lit(0).cast(series.schema["y"].dataType))
    else:
        value = F.last("y", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_day"))
    return days.select(F.col("_key").alias("series_key"), F.col("_day").alias("ds"), value.alias("y"), F.col("y").isNull().alias("filled"))


def daily_revenue_filled(model: SalesModel, fill: str = "zero") -> DataFrame:
    """Revenue of every calendar day, also of days without orders."""
    return on_calendar(daily_series(model), fill).select(midnight("ds").alias("ds"), F.col("y").cast("double").alias("y"), "filled").orderBy("ds")


# ------------------------------------------------------------------ moving-average forecast

def moving_average_from_series(series: DataFrame, periods: int = 90, window: int = 30,
                               low: float = 0.8, high: float = 1.2) -> DataFrame:
    """(series_key, ds, yhat, yhat_lower, yhat_upper, is_future) from (series_key, ds, y DECIMAL)."""
    recent = Window.partitionBy("series_key").orderBy(F.desc("ds"))
    tail = series.withColumn("_k", F.row_number().over(recent)).filter(F.col("_k") <= window)
    level = tail.groupBy("series_key").agg(
        F.max("ds").alias("_last"),
        F.count("y").alias("_n"),
        F.sum("y").alias("_s"),
    ).select(
        "series_key", "_last",
        F.when(F.col("_n") == window, F.col("_s").cast("double") / F.lit(float(window)))
        .alias("_mean"),
    )
    future = level.select(
        "series_key",
        F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", periods))).alias("ds"),
        F.col("_mean").alias("yhat"),
        (F.col("_mean") * F.lit(low)).alias("yhat_lower"),
        (F.col("_mean") * F.lit(high)).alias("yhat_upper"),
        F.lit(True).alias("is_future"),
    )
    history = series.select("series_key", "ds", F.col("y").cast("double").alias("yhat"), F.lit(False).alias("is_future"))
    return history.unionByName(future, allowMissingColumns=True)


def moving_average_forecast(model: SalesModel, periods: int = 90, fill: str | None = None) -> DataFrame:
    """``fill``: gaps of the calendar are filled first (:func:`on_calendar`), so the mean is that of the last 30 days instead of rows."""
    fc = moving_average_from_series(on_calendar(daily_series(model), fill).select("series_key", "ds", "y"), periods)
    return fc.select(midnight("ds").alias("ds"), "yhat", "yhat_lower", "yhat_upper").orderBy("ds")


METHODS = ("moving_average", "seasonal")


def forecast_from_series(series: DataFrame, method: str = "moving_average", periods: int = 90) -> DataFrame:
    """(series_key, ds, yhat, yhat_lower, yhat_upper, is_future) of every series by one of ``METHODS``."""
    if method == "moving_average":
        return moving_average_from_series(series, periods)
    if method == "seasonal":
        return seasonal_forecast_of(series, periods).withColumn("ds", F.to_date("ds"))
    raise ValueError(f"method must be one of {METHODS}, not {method!r}")


def total_forecast(model: SalesModel, method: str = "moving_average", periods: int = 90) -> DataFrame:
    """The total series' forecast. The daily series is materialised once, so items are read once."""
    return forecast_from_series(cut_lineage(daily_series(model), "daily"), method, periods)


def forecast_summary_of(forecast: DataFrame) -> DataFrame:
    """Over the future rows of each series: total, mean, peak value and the first day reaching
    the peak (rounded to cents)."""
    return forecast.filter("is_future").groupBy("series_key").agg(
        (F.round(F.sum("yhat") * 100, 0) / 100).alias("forecast_total"),
        (F.round(F.avg("yhat") * 100, 0) / 100).alias("forecast_daily_mean"),
        (F.round(F.max("yhat") * 100, 0) / 100).alias("peak_value"),
        midnight(F.min_by("ds", F.struct(-F.col("yhat"), F.col("ds")))).alias("peak_date"),
    )


def forecast_summary(model: SalesModel, periods: int = 90, method: str = "moving_average") -> DataFrame:
    return forecast_summary_of(total_forecast(model, method, periods)).drop("series_key")


def forecast_summary_seasonal(model: SalesModel) -> DataFrame:
    """The summary of the seasonal model's forecast."""
    return forecast_summary(model, method="seasonal")


def actual_vs_forecast_of(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Actuals and the forecast side by side per day; band only after the last actual day."""
    act = actual.select("series_key", "ds", F.col("y").cast("double").alias("actual"))
    joined = act.join(forecast, on=["series_key", "ds"], how="full_outer")
    future = F.coalesce("is_future", F.lit(False))
    return joined.select(
        "series_key", "ds", "actual",
        F.when(~future, F.col("yhat")).alias("fitted"),
        F.when(future, F.col("yhat")).alias("forecast"),
        F.when(future, F.col("yhat_lower")).alias("forecast_lower"),
        F.when(future, F.col("yhat_upper")).alias("forecast_upper"),
    )


def actual_vs_forecast(model: SalesModel, periods: int = 90, method: str = "moving_average") -> DataFrame:
    series = cut_lineage(daily_series(model), "daily")
    return actual_vs_forecast_of(series, forecast_from_series(series, method, periods)).drop("series_key") \
        .withColumn("ds", midnight("ds")).orderBy("ds")


# ------------------------------------------------------------------------- seasonal model

# Model structure and prior scales of the additive forecast.
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
YEARLY_ORDER = 10
WEEKLY_ORDER = 3
YEAR_DAYS = 365.25
CHANGEPOINT_PRIOR = 0.05
SEASONALITY_PRIOR = 10.0
TREND_PRIOR = 5.0
INTERVAL_LEVEL = 0.80

# Least noise of a series, as a share of its largest value: keeps the priors in force and the band
# positive where a series is fitted exactly (constant, linear or short ones).
NOISE_FLOOR = 0.005
# Multiples of the changepoint penalty that propose sets of changepoints, and rounds in which penalty and noise are settled.
PENALTY_FACTORS = (1.0, 10.0, 100.0, 1000.0, 10_000.0, 1e9)
NOISE_ROUNDS = 4
# Variances of a slope change, as multiples of the noise, among which the likeliest is taken.
CHANGE_RATIOS = tuple(10.0 ** (e / 3) for e in range(-9, 19))
DAYS_PER_CHUNK = 512

# Parts of the model that a series must be long enough for; shorter ones go without them.
MIN_ROWS_SLOPE = 3
MIN_SPAN_WEEKLY = 14
MIN_SPAN_YEARLY = 365

N_TREND = 2 + N_CHANGEPOINTS
N_YEARLY = 2 * YEARLY_ORDER
N_WEEKLY = 2 * WEEKLY_ORDER
N_FEATURES = N_TREND + N_YEARLY + N_WEEKLY


def _fourier(day: Column, period: float, order: int) -> list[Column]:
    cols = []
    for k in range(1, order + 1):
        angle = day * F.lit(2.0 * math.pi * k / period)
        cols += [F.sin(angle), F.cos(angle)]
    return cols


def design(day: Column, start: Column, span: Column) -> list[Column]:
    """Regressors for an epoch-day ``day`` of a series starting at epoch-day ``start`` whose
    history spans ``span`` days: [1, t, hinges..., yearly sin/cos..., weekly sin/cos...]."""
    t = (day - start).cast("double") / span.cast("double")
    hinges = [F.greatest(t - F.lit(CHANGEPOINT_RANGE * j / N_CHANGEPOINTS), F.lit(0.0))
              for j in range(1, N_CHANGEPOINTS + 1)]
    return [F.lit(1.0), t, *hinges,
            *_fourier(day.cast("double"), YEAR_DAYS, YEARLY_ORDER),
            *_fourier(day.cast("double"), 7.0, WEEKLY_ORDER)]


def _epoch_day(ds: Column) -> Column:
    return F.datediff(ds, F.lit(EPOCH).cast("date"))


def gram_by_series(series: DataFrame) -> DataFrame:
    """One row per series: n, span, scale and the summed upper triangle of [X y]^T [X y]."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    stats = series.groupBy("series_key").agg(
        F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"),
        F.max(F.abs(F.col("y").cast("double"))).alias("_ymax"),
    ).select(
        "series_key", "first_ds", "last_ds",
        F.greatest(F.datediff("last_ds", "first_ds"), F.lit(1)).alias("span"),
        F.when(F.col("_ymax") > 0, F.col("_ymax")).otherwise(F.lit(1.0)).alias("scale"),
    )
    # The Gram products are CPU-heavy per row while the daily table is small: spread its rows
    # over all cores by (series, day) -- a dominant series is split too -- and let the
    # Summarizer combine per-partition partial sums per series.
    rows = series.join(stats, on="series_key", how="inner") \
        .repartition(_spread(series, series.count()), "series_key", "ds")
    x = design(_epoch_day(F.col("ds")), _epoch_day(F.col("first_ds")), F.col("span"))
    z = F.array(*x, (F.col("y").cast("double") / F.col("scale")))
    zz = rows.select("series_key", z.alias("_z"))
    # Row-major upper triangle of z z^T (same order as numpy.triu_indices), as nested
    # higher-order functions: a compact expression whatever the number of regressors.
    zc, width = F.col("_z"), N_FEATURES + 1
    products = F.flatten(F.transform(
        F.sequence(F.lit(1), F.lit(width)),
        lambda i: F.transform(F.slice(zc, i, F.lit(width) + 1 - i),
                              lambda v: v * F.element_at(zc, i))))
    summed = zz.select("series_key", array_to_vector(products).alias("_p")) \
        .groupBy("series_key").agg(
            Summarizer.metrics("sum", "count").summary(F.col("_p")).alias("_s"))
    summed = summed.select("series_key", vector_to_array(F.col("_s.sum")).alias("gram"),
                           F.col("_s.count").alias("n"))
    return summed.join(stats, on="series_key", how="inner")


def _ridge(m: np.ndarray, penalties: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Coefficients, residual sum of squares and effective parameters of a ridge fit from [X y]^T [X y]."""
    k = N_FEATURES
    g, b, yy = m[:k, :k], m[:k, k], m[k, k]
    solved = np.linalg.solve(g + np.diag(penalties), np.column_stack([b, g]))
    beta = solved[:, 0]
    rss = max(yy - 2.0 * beta @ b + beta @ g @ beta, 0.0)
    return beta, rss, float(np.trace(solved[:, 1:]))


def _left_out(n: int, span: int) -> np.ndarray:
    """Which coefficients a series of ``n`` rows over ``span`` days is too short for: the slope under 3 rows,
    changepoints while rows don't outnumber the parameters, weekly terms under two weeks, yearly ones under a year."""
    out = np.zeros(N_FEATURES, bool)
    out[1] = n < MIN_ROWS_SLOPE
    out[2:N_TREND] = n <= N_FEATURES
    out[N_TREND:N_TREND + N_YEARLY] = span < MIN_SPAN_YEARLY
    out[N_TREND + N_YEARLY:] = span + 1 < MIN_SPAN_WEEKLY or n < MIN_SPAN_WEEKLY
    return out


def _lasso(s: np.ndarray, pull: np.ndarray, l1: float) -> np.ndarray:
    """Minimum of x's x / 2 - pull x + l1 sum |x|, exactly: variables enter by the largest gradient, the signed system of those in use is solved, and a
    variable that would change its sign on the way leaves."""
    x, size = np.zeros(len(pull)), len(pull)
    slack = 1e-9 * max(1.0, float(np.abs(pull).max(initial=0.0)))
    for _ in range(20 * size):
        gradient = pull - s @ x
        rest = np.where(x == 0, np.abs(gradient), 0.0)
        used = x != 0
        signs = np.sign(x)
        settled = not used.any() or np.abs(gradient[used] - l1 * signs[used]).max() <= slack
        if settled:
            enters = int(rest.argmax())
            if rest[enters] <= l1 + slack:
                break
            used[enters], signs[enters] = True, np.sign(gradient[enters])
        at = np.flatnonzero(used)
        block = s[np.ix_(at, at)]
        goal = np.linalg.solve(block + 1e-13 * np.trace(block) * np.eye(len(at)), pull[at] - l1 * signs[at])
        # the best point on the way: at the goal, or where a variable reaches zero
        here, steps = x[at], [1.0]
        with np.errstate(divide="ignore", invalid="ignore"):
            crossing = here / (here - goal)
        steps += [c for c in crossing if 0.0 < c < 1.0]
        value = lambda v: 0.5 * v @ block @ v - pull[at] @ v + l1 * np.abs(v).sum()
        points = [here + c * (goal - here) for c in steps]
        best = min(points, key=value)
        best[np.abs(best) < 1e-14 * max(1.0, np.abs(best).max())] = 0.0
        if value(best) >= value(here) - 1e-18 and not settled:
            break
        x[at] = best
    return x


def _lasso_hinges(g: np.ndarray, b: np.ndarray, penalties: np.ndarray, hinges: np.ndarray, others: np.ndarray, l1: float) -> np.ndarray:
    """Minimum of half the squared error plus ``l1`` times the sum of |hinge coefficients| (and the ridge penalties of the others), from
    the Gram matrix alone: the others are eliminated first."""
    beta = np.zeros(len(b))
    a = g[np.ix_(others, others)] + np.diag(penalties[others])
    cross = g[np.ix_(others, hinges)]
    solved = np.linalg.solve(a, np.column_stack([b[others], cross]))
    s = g[np.ix_(hinges, hinges)] - cross.T @ solved[:, 1:]
    delta = _lasso((s + s.T) / 2, b[hinges] - cross.T @ solved[:, 0], l1)
    beta[hinges] = delta
    beta[others] = solved[:, 0] - solved[:, 1:] @ delta
    return beta


def _sparse_fit(m: np.ndarray, n: int, sigma2: float, tau: np.ndarray, hinges: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, float]:
    """(coefficients, noise variance) under the Laplace prior. Little noise makes the prior's penalty weak, and then every
    hinge takes some of the noise; so sets of hinges are proposed by growing multiples of the penalty and fitted with the prior's own,
    and the set with the least BIC stays. Penalty and noise are settled together, as a first noise estimate takes a break for noise."""
    k, best = N_FEATURES, None
    for factor in PENALTY_FACTORS:
        noise = sigma2
        for _ in range(NOISE_ROUNDS):
            l1, penalties = noise / CHANGEPOINT_PRIOR, noise / tau ** 2
            chosen = hinges[_lasso_hinges(m[:k, :k], m[:k, k], penalties, hinges, others, l1 * factor)[hinges] != 0]
            beta = _lasso_hinges(m[:k, :k], m[:k, k], penalties, chosen, others, l1)
            used = len(others) + np.count_nonzero(beta[hinges])
            rss = _rss(m, beta)
            before, noise = noise, max(rss / max(n - used, 1.0), NOISE_FLOOR ** 2)
            if abs(noise - before) <= 1e-2 * before:
                break
        score = n * math.log(max(rss / n, NOISE_FLOOR ** 2)) + 2.0 * used * math.log(n)  # a hinge is a place and a size
        if best is None or score < best[0]:
            best = (score, beta, noise)
    return best[1], best[2]


def _rss(m: np.ndarray, beta: np.ndarray) -> float:
    k = N_FEATURES
    return max(float(m[k, k] - 2.0 * beta @ m[:k, k] + beta @ m[:k, :k] @ beta), 0.0)


def _change_variance(m: np.ndarray, n: int, hinges: np.ndarray, others: np.ndarray) -> float:
    """The variance of a changepoint's size with the largest marginal likelihood. A sparse fit leaves out small changes and merges
    neighbours, so its sizes would understate how much the slope moves; 0 if no change is likelier."""
    k, best = N_FEATURES, (-math.inf, 0.0)
    for ratio in (0.0, *CHANGE_RATIOS):  # to the noise variance
        at = others if ratio == 0.0 else np.r_[others, hinges]
        a = m[np.ix_(at, at)] + np.diag(np.r_[np.full(len(others), 1e-6), np.full(len(at) - len(others), 1.0 / max(ratio, 1e-300))])
        rest = float(m[k, k] - m[at, k] @ np.linalg.solve(a, m[at, k]))
        noise = max(rest / n, NOISE_FLOOR ** 2)
        score = -0.5 * (n * math.log(noise) + np.linalg.slogdet(a)[1] + (len(at) - len(others)) * math.log(max(ratio, 1e-300)) + rest / noise)
        if score > best[0]:
            best = (score, ratio * noise)
    return best[1]


def solve_series(upper: np.ndarray, n: int, span: int, prior: str = "laplace") -> dict:
    """The fit in scaled units from the upper triangle of [X y]^T [X y]: ``beta``, ``sigma`` (noise), ``drift`` (variance of the
    slope's changes per unit of time) and ``factor``, with which |x factor|^2 sigma^2 is the mean squared error of x beta."""
    if prior not in ("laplace", "gaussian"):
        raise ValueError(f"unknown prior {prior}")
    k = N_FEATURES
    m = np.zeros((k + 1, k + 1))
    m[np.triu_indices(k + 1)] = upper
    m = m + np.triu(m, 1).T
    out = _left_out(n, span)
    # Pass 1: trend without changepoints, light seasonality -> noise variance.
    free = np.r_[np.full(2, 1e-9), np.full(N_CHANGEPOINTS, 1e9), np.full(N_YEARLY + N_WEEKLY, 1e-6)]
    free[out] = 1e9
    _, rss, used = _ridge(m, free)
    sigma2 = max(rss / max(n - used, 1.0), NOISE_FLOOR ** 2)
    # Pass 2: MAP with the priors, penalty sigma^2 / tau^2 (sigma^2 / tau for the L1 form) per coefficient.
    tau = np.r_[np.full(2, TREND_PRIOR), np.full(N_CHANGEPOINTS, CHANGEPOINT_PRIOR),
                np.full(N_YEARLY + N_WEEKLY, SEASONALITY_PRIOR)]
    hinges = np.array([j for j in range(2, N_TREND) if not out[j]], int)
    others = np.array([j for j in range(k) if not out[j] and not 2 <= j < N_TREND], int)
    if prior == "gaussian" or not len(hinges):
        penalties = np.where(out, 1e9, sigma2 / tau ** 2)
        beta, rss, used = _ridge(m, penalties)
        beta[out] = 0.0
        sigma2 = max(rss / max(n - used, 1.0), NOISE_FLOOR ** 2)
    else:
        beta, sigma2 = _sparse_fit(m, n, sigma2, tau, hinges, others)
    each = _change_variance(m, n, hinges, others) if len(hinges) else 0.0
    drift = each * N_CHANGEPOINTS / CHANGEPOINT_RANGE
    spread = np.where((np.arange(k) >= 2) & (np.arange(k) < N_TREND), max(each, 1e-18), tau ** 2)
    held = np.flatnonzero(~out)
    a = m[np.ix_(held, held)] + np.diag(sigma2 / spread[held])
    factor = np.zeros((k, k + 1))
    factor[np.ix_(held, held)] = np.linalg.inv(np.linalg.cholesky(a)).T
    # the last column: how far the sparse fit lies from the likeliest one with all changes
    likeliest = np.linalg.solve(a, m[held, k])
    factor[held, k] = (beta[held] - likeliest) / math.sqrt(sigma2)
    return {"beta": beta, "sigma": math.sqrt(sigma2), "drift": drift, "factor": factor}


def _solve_batches(batches, level: float, prior: str):
    z = NormalDist().inv_cdf(0.5 + level / 2.0)
    for pdf in batches:
        fits = [solve_series(np.asarray(upper, dtype=float), int(n), int(span), prior)
                for upper, n, span in zip(pdf["gram"], pdf["n"], pdf["span"])]
        yield pd.DataFrame({
            "series_key": pdf["series_key"], "beta": [f["beta"].tolist() for f in fits], "sigma": [f["sigma"] for f in fits], "z": z,
            "first_ds": pdf["first_ds"], "last_ds": pdf["last_ds"], "span": pdf["span"],
            "scale": pdf["scale"], "drift": [f["drift"] for f in fits], "factor": [f["factor"].reshape(-1).tolist() for f in fits],
        })


FIT_SCHEMA = T.StructType([
    T.StructField("series_key", T.StringType()),
    T.StructField("beta", T.ArrayType(T.DoubleType())),
    T.StructField("sigma", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
    T.StructField("first_ds", T.DateType()),
    T.StructField("last_ds", T.DateType()),
    T.StructField("span", T.IntegerType()),
    T.StructField("scale", T.DoubleType()),
    T.StructField("drift", T.DoubleType()),
    T.StructField("factor", T.ArrayType(T.DoubleType())),
])


def fit_seasonal(series: DataFrame, level: float = INTERVAL_LEVEL, prior: str = "laplace") -> DataFrame:
    """One row per series: coefficients (scaled units), sigma, z, what the band needs, and the series' calendar.
    The result is one row per series; it is checkpointed so the scorers that read it (forecast,
    weekly and yearly effects) never recompute the Gram aggregation."""
    # The daily series (one row per series and day) feeds both the per-series statistics and
    # the Gram rows; materialise it once so the order/item pipeline below it runs once.
    series = cut_lineage(series.select("series_key", "ds", "y"))
    gram = gram_by_series(series).select("series_key", "gram", "n", "first_ds", "last_ds",
                                         "span", "scale")
    return cut_lineage(gram.mapInPandas(lambda it: _solve_batches(it, level, prior), schema=FIT_SCHEMA))


def _dot(x: list[Column], beta: Column, lo: int, hi: int) -> Column:
    total = F.lit(0.0)
    for i in range(lo, hi):
        total = total + x[i] * beta[i]
    return total


ROWS_PER_TASK = 20_000


def _spread(df: DataFrame, rows: int) -> int:
    """Partitions for CPU-heavy work on ``rows`` small rows: every core, and more as the rows grow."""
    return max(1, df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def _design_rows(day: np.ndarray, start: int, span: int) -> np.ndarray:
    """The rows of :func:`design` for epoch-days ``day``."""
    t = (day - start) / float(span)
    hinges = [np.maximum(t - CHANGEPOINT_RANGE * j / N_CHANGEPOINTS, 0.0) for j in range(1, N_CHANGEPOINTS + 1)]
    waves = [f(day * (2.0 * math.pi * k / period)) for period, order in ((YEAR_DAYS, YEARLY_ORDER), (7.0, WEEKLY_ORDER))
             for k in range(1, order + 1) for f in (np.sin, np.cos)]
    return np.column_stack([np.ones(len(day)), t, *hinges, *waves])


SCORED = "series_key string, day int, trend double, yearly double, weekly double, half double, is_future boolean"


def _score_batches(batches, periods: int):
    epoch = pd.Timestamp(EPOCH).date()
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            start, last = (row.first_ds - epoch).days, (row.last_ds - epoch).days
            day = np.arange(start + row.at, min(start + row.at + DAYS_PER_CHUNK, last + periods + 1))
            x, beta = _design_rows(day.astype(float), start, row.span), np.asarray(row.beta)
            part = lambda lo, hi: x[:, lo:hi] @ beta[lo:hi] * row.scale
            fitted = ((x @ np.asarray(row.factor).reshape(N_FEATURES, N_FEATURES + 1)) ** 2).sum(axis=1)
            # changes of the slope after the history, as large and as frequent as before
            changes = row.drift * np.maximum(x[:, 1] - 1.0, 0.0) ** 3 / 3.0
            half = row.z * row.scale * np.sqrt(row.sigma ** 2 * (1.0 + fitted) + changes)
            yield pd.DataFrame({"series_key": row.series_key, "day": day.astype("int32"), "trend": part(0, N_TREND),
                                "yearly": part(N_TREND, N_TREND + N_YEARLY), "weekly": part(N_TREND + N_YEARLY, N_FEATURES),
                                "half": half, "is_future": day > last})


def score_seasonal(fit: DataFrame, periods: int = 90) -> DataFrame:
    """Every day of every series and ``periods`` days beyond, in chunks of days spread over all cores."""
    days = F.datediff("last_ds", "first_ds") + 1 + periods
    rows = fit.agg(F.sum(days)).first()[0] or 0
    chunks = fit.select("series_key", "beta", "sigma", "z", "first_ds", "last_ds", "span", "scale", "drift", "factor",
                        F.explode(F.sequence(F.lit(0), days - 1, F.lit(DAYS_PER_CHUNK))).alias("at"))
    chunks = chunks.repartition(min(_spread(fit, rows), max(1, -(-rows // DAYS_PER_CHUNK))), "series_key", "at")
    scored = chunks.mapInPandas(lambda it: _score_batches(it, periods), schema=SCORED)
    yhat = F.col("trend") + F.col("yearly") + F.col("weekly")
    return scored.select("series_key", midnight(F.date_from_unix_date("day")).alias("ds"), yhat.alias("yhat"),
                         (yhat - F.col("half")).alias("yhat_lower"),
                         (yhat + F.col("half")).alias("yhat_upper"),
                         "trend", "yearly", "weekly", "is_future")


def seasonal_forecast_of(series: DataFrame, periods: int = 90,
                         level: float = INTERVAL_LEVEL, prior: str = "laplace") -> DataFrame:
    return score_seasonal(fit_seasonal(series, level, prior), periods)


def seasonal_forecast(model: SalesModel, periods: int = 90, by: str | None = None, fill: str | None = None) -> DataFrame:
    return seasonal_forecast_of(on_calendar(daily_series(model, by), fill), periods).drop("is_future")


def series_moments(model: SalesModel) -> DataFrame:
    """What the seasonal fit is computed from, per customer state: rows, span, scale, and three of the summed products (y,
    t times y, y squared; scaled, to six places)."""
    gram = gram_by_series(cut_lineage(daily_series(model, "customer_state"), "daily"))
    width = N_FEATURES + 1
    at = {"sum_y": width, "sum_ty": 2 * width - 1, "sum_yy": width * (width + 1) // 2}  # 1-based, upper triangle by rows
    return gram.select("series_key", F.col("n").cast("bigint").alias("n"), F.col("span").cast("bigint").alias("span"), "scale",
                       *[(F.round(F.element_at("gram", k) * 1e6, 0) / 1e6).alias(name) for name, k in at.items()])


def seasonal_forecast_by_state(model: SalesModel, periods: int = 90) -> DataFrame:
    """One model per customer state, fitted together (series_key = state)."""
    return seasonal_forecast(model, periods, by="customer_state")


def weekly_effects(fit: DataFrame) -> DataFrame:
    """Weekly term per weekday (Sunday = 0), in revenue units."""
    sunday = F.lit("1970-01-04").cast("date")
    days = fit.select("*", F.explode(F.sequence(sunday, F.date_add(sunday, 6))).alias("ds"))
    x = design(_epoch_day(F.col("ds")), _epoch_day(F.col("first_ds")), F.col("span"))
    effect = _dot(x, F.col("beta"), N_TREND + N_YEARLY, N_FEATURES) * F.col("scale")
    return days.select("series_key", weekday_name("ds").alias("weekday"),
                       weekday_number("ds").alias("day_num"), effect.alias("effect"))


def seasonality_weekly(model: SalesModel) -> DataFrame:
    return weekly_effects(fit_seasonal(daily_series(model))).drop("series_key").orderBy("day_num")


def yearly_effects(fit: DataFrame, periods: int = 90) -> DataFrame:
    """The yearly term of every day, in revenue units; no other term is computed."""
    days = fit.select("series_key", "beta", "scale", F.explode(F.sequence("first_ds", F.date_add("last_ds", periods))).alias("ds"))
    waves = _fourier(_epoch_day(F.col("ds")).cast("double"), YEAR_DAYS, YEARLY_ORDER)
    effect = sum((w * F.col("beta")[N_TREND + i] for i, w in enumerate(waves)), F.lit(0.0)) * F.col("scale")
    return days.select("series_key", midnight("ds").alias("ds"), effect.alias("yearly"))


def seasonality_yearly(model: SalesModel, periods: int = 90) -> DataFrame:
    return yearly_effects(fit_seasonal(daily_series(model)), periods).drop("series_key").orderBy("ds")


def forecast_band_growth(model: SalesModel, periods: int = 90) -> DataFrame:
    """Per customer state: days of history and forecast, and whether the band gets narrower (by over 1 %) between the end of the history and
    the end of the forecast."""
    scored = seasonal_forecast_of(daily_series(model, "customer_state"), periods)
    width = F.col("yhat_upper") - F.col("yhat_lower")
    return scored.groupBy("series_key").agg(
        F.count_if(~F.col("is_future")).alias("history_days"), F.count_if("is_future").alias("future_days"),
        (F.max_by(width, "ds") < 0.99 * F.max_by(width, F.when(~F.col("is_future"), F.col("ds")))).alias("narrows"))
