"""The seasonal fit from Gram matrices alone: sparse changepoints, bands that widen and cover."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.plans import forecast

START = 16_000  # an epoch-day


def gram(y, start=START):
    days = np.arange(start, start + len(y), dtype=float)
    scale = np.abs(y).max() or 1.0
    z = np.column_stack([forecast._design_rows(days, start, max(len(y) - 1, 1)), y / scale])
    m = z.T @ z
    return m[np.triu_indices(len(m))], scale


def weekly(n):
    return np.array([30, -20, 10, 0, -5, 5, -20])[np.arange(n) % 7]


def scored(y, periods=90, prior="laplace"):
    upper, scale = gram(y)
    fit = forecast.solve_series(upper, len(y), len(y) - 1, prior)
    epoch = dt.date(1970, 1, 1)
    row = {"series_key": "s", "beta": fit["beta"], "sigma": fit["sigma"], "z": 1.2815515655446004, "first_ds": epoch + dt.timedelta(START),
           "last_ds": epoch + dt.timedelta(START + len(y) - 1), "span": len(y) - 1, "scale": scale, "drift": fit["drift"],
           "factor": fit["factor"].reshape(-1), "at": 0}
    frames = [pd.DataFrame([{**row, "at": at}]) for at in range(0, len(y) + periods, forecast.DAYS_PER_CHUNK)]
    return fit, pd.concat(forecast._score_batches(frames, periods))


@pytest.mark.parametrize("at,change", [(0.4, 3.0), (0.62, -2.0), (0.2, 1.0)])
def test_a_single_break_needs_few_changepoints(at, change):
    rng, n = np.random.default_rng(4), 900
    t = np.arange(n)
    y = 1000 + 0.5 * t + change * np.maximum(t - at * n, 0) + weekly(n) + rng.normal(0, 8, n)
    fit, out = scored(y)
    hinges = fit["beta"][2:forecast.N_TREND]
    used = np.flatnonzero(hinges)
    assert 1 <= len(used) <= 3
    places = forecast.CHANGEPOINT_RANGE * (used + 1) / forecast.N_CHANGEPOINTS
    assert np.abs(places - at).min() < 0.05
    assert abs(hinges.sum() * out["trend"].abs().max() / n) > 0  # and the trend follows the break
    assert np.abs(out["trend"].to_numpy()[:n] - (1000 + 0.5 * t + change * np.maximum(t - at * n, 0))).max() < 25
    dense, _ = scored(y, prior="gaussian")
    assert np.count_nonzero(dense["beta"][2:forecast.N_TREND]) == forecast.N_CHANGEPOINTS


def test_calm_series_have_no_changepoints():
    for slope in (0.0, 0.3):
        for noise in (0.0, 10.0):
            y = 500 + slope * np.arange(700) + weekly(700) + np.random.default_rng(1).normal(0, noise, 700)
            fit, _ = scored(y)
            assert np.count_nonzero(fit["beta"][2:forecast.N_TREND]) == 0 and fit["drift"] < 1e-3


def test_lasso_meets_its_optimality_conditions():
    """Gradient equals the penalty where a hinge is in use, and stays below it where not."""
    rng, n = np.random.default_rng(7), 800
    y = 100 + np.cumsum(rng.normal(0, 1.5, n)) + weekly(n)
    upper, _ = gram(y)
    m = np.zeros((forecast.N_FEATURES + 1,) * 2)
    m[np.triu_indices(len(m))] = upper
    m = m + np.triu(m, 1).T
    k = forecast.N_FEATURES
    hinges, others = np.arange(2, forecast.N_TREND), np.r_[0, 1, np.arange(forecast.N_TREND, k)]
    penalties, l1 = np.full(k, 0.01), 0.05
    beta = forecast._lasso_hinges(m[:k, :k], m[:k, k], penalties, hinges, others, l1)
    slope = m[:k, k] - m[:k, :k] @ beta
    assert np.abs(slope[others] - penalties[others] * beta[others]).max() < 1e-6
    used = hinges[beta[hinges] != 0]
    assert 0 < len(used) < len(hinges)
    assert np.abs(slope[used] - l1 * np.sign(beta[used])).max() < 1e-4 and np.abs(slope[hinges]).max() < l1 + 1e-4


def planted(rng, n, breaks):
    """A series as the model sees it: slope changes of Laplace sizes in the first 80 % of the history and beyond its end."""
    t = np.arange(n + 90)
    y = 1000 + rng.normal(0, 0.5) * t + weekly(n + 90) * 2.0
    for at in np.flatnonzero(rng.random(n + 90) < breaks):
        if at < forecast.CHANGEPOINT_RANGE * n or at >= n:
            y = y + rng.laplace(0, 0.6) * np.maximum(t - at, 0)
    return y + rng.normal(0, 12, n + 90)


@pytest.mark.parametrize("breaks", [0.0, 25 / 730])
def test_bands_cover_held_out_days(breaks):
    """80 % bands 1, 30 and 90 days ahead over many planted series."""
    rng, n = np.random.default_rng(11), 730
    inside = {h: [] for h in (1, 30, 90)}
    for _ in range(150):
        y = planted(rng, n, breaks)
        _, out = scored(y[:n])
        for h in inside:
            row = out.iloc[n + h - 1]
            yhat = row.trend + row.yearly + row.weekly
            inside[h].append(abs(y[n + h - 1] - yhat) <= row.half)
    for h, hits in inside.items():
        assert 0.70 <= np.mean(hits) <= 0.92, (h, np.mean(hits))


def test_bands_widen_with_the_horizon():
    rng = np.random.default_rng(3)
    for breaks in (0.0, 0.03):
        _, out = scored(planted(rng, 730, breaks)[:730], periods=180)
        half = out["half"].rolling(7).mean().to_numpy()  # weekly terms move the width by a little
        if breaks:
            assert half[729] * 1.1 < half[729 + 30] < half[729 + 90] / 1.1 < half[729 + 180] / 1.3
        assert all(half[729 + a] * 0.995 < half[729 + b] for a, b in ((0, 30), (30, 90), (90, 180)))


def test_scores_do_not_depend_on_chunks(spark, monkeypatch):
    y = 500 + 0.2 * np.arange(800) + weekly(800)
    rows = [("s", dt.date(2013, 1, 1) + dt.timedelta(days=k), float(v)) for k, v in enumerate(y)]
    fit = forecast.fit_seasonal(spark.createDataFrame(rows, "series_key string, ds date, y double"))
    whole = forecast.score_seasonal(fit).orderBy("ds").toPandas()
    monkeypatch.setattr(forecast, "DAYS_PER_CHUNK", 37)
    parts = forecast.score_seasonal(fit).orderBy("ds").toPandas()
    assert len(whole) == 890 and np.allclose(whole.iloc[:, 2:8].astype(float), parts.iloc[:, 2:8].astype(float), rtol=1e-9)
    effects = forecast.yearly_effects(fit).orderBy("ds").toPandas()
    assert (effects["ds"] == whole["ds"]).all() and np.allclose(effects["yearly"], whole["yearly"], atol=1e-6)
    assert fit.select(F.size("factor")).first()[0] == forecast.N_FEATURES * (forecast.N_FEATURES + 1)
