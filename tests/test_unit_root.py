"""The unit-root test with lags against a dense solution."""

import datetime
import math

import numpy as np
import pytest

from marketloom.operators.timeseries import augmented_dickey_fuller, unit_root_pvalue


def dense(y, k, skip):
    """Statistic, residuals and rows of the regression with ``k`` lags, from row ``skip`` on."""
    d = np.diff(y)
    rows = range(max(skip, k), len(d))
    x = np.array([[1, y[t], *[d[t - j] for j in range(1, k + 1)]] for t in rows])
    target = d[list(rows)]
    beta, *_ = np.linalg.lstsq(x, target, rcond=None)
    rest = ((target - x @ beta) ** 2).sum()
    error = math.sqrt(rest / (len(x) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    return beta[1] / error, rest, len(x)


def test_against_dense_solution(spark):
    rng = np.random.default_rng(2)
    series = {"walk": 100 + rng.normal(size=400).cumsum(), "noise": 50 + rng.normal(size=300)}
    wave = [30.0, 30.5]
    for e in rng.normal(size=2500):  # more than two blocks
        wave.append(5 + 1.2 * wave[-1] - 0.4 * wave[-2] + e)
    series["wave"] = np.array(wave)
    start = datetime.datetime(2010, 1, 1)
    rows = [(k, start + datetime.timedelta(days=i), float(v)) for k, y in series.items() for i, v in enumerate(y)]
    rows += [("flat", start + datetime.timedelta(days=i), 7.0) for i in range(30)]
    rows += [("short", start + datetime.timedelta(days=i), float(i * i)) for i in range(3)]
    df = spark.createDataFrame(rows, "ticker string, date timestamp_ntz, close double")
    got = {r.ticker: r for r in augmented_dickey_fuller(df, max_lag=6).collect()}
    for name, y in series.items():
        aic = []
        for k in range(7):
            _, rest, n = dense(y, k, 6)
            aic.append(n * math.log(rest / n) + 2 * (k + 2))
        best = int(np.argmin(aic))
        statistic, _, n = dense(y, best, best)
        assert (got[name].lag, got[name].n_obs) == (best, n)
        assert got[name].adf_statistic == pytest.approx(statistic, rel=1e-6)
        assert got[name].p_value == pytest.approx(unit_root_pvalue(statistic), rel=1e-4, abs=1e-12)
    assert got["flat"].adf_statistic is None and got["short"].p_value is None
    assert got["noise"].p_value < 0.01 < 0.05 < got["walk"].p_value


def test_pvalues():
    """Published critical values of the statistic."""
    for statistic, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert unit_root_pvalue(statistic) == pytest.approx(p, abs=0.002)
    assert unit_root_pvalue(-30) == 0 and unit_root_pvalue(5) == 1
