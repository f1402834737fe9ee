"""Totals, quantiles, cuts, drift and metrics with hot values and hot groups."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions.stats import _chi2_tail
from marketloom.operators import drift, models, ordering, timeseries
from marketloom.operators.ordering import exact_quantiles, running_totals


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    values = np.concatenate([np.full(4000, 3.25), rng.normal(0, 10, 8000).round(2)])
    return pd.DataFrame({"x": values, "y": rng.integers(0, 50, 12000).astype(float)})


def test_running_totals(spark, skewed):
    counts = spark.createDataFrame(skewed).groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"))
    got = running_totals(counts, ["y"], "x", ["n"]).toPandas().sort_values(["y", "x"])
    want = skewed.groupby(["y", "x"]).size().groupby(level=0).cumsum()
    np.testing.assert_array_equal(got["cum_n"], want.to_numpy())
    np.testing.assert_array_equal(got["total_n"], got.groupby("y")["n"].transform("sum"))
    following = got.groupby("y")["x"].shift(-1)
    np.testing.assert_array_equal(got["next_value"].astype(float), following)


def test_quantiles(spark, skewed):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(spark.createDataFrame(skewed), ["x", "y"], probs).toPandas()
    for c in ("x", "y"):
        mine = got[got["column"] == c].sort_values("prob")["quantile"]
        np.testing.assert_allclose(mine, np.quantile(skewed[c], probs), rtol=1e-12)


def test_auc_with_ties(spark):
    rng = np.random.default_rng(3)
    score, label = rng.integers(0, 20, 500) / 20, rng.integers(0, 2, 500)
    df = spark.createDataFrame(pd.DataFrame({"model": "m", "score": score, "label": label}))
    pos, neg = score[label == 1], score[label == 0]
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    got = models.roc_auc(df, ["model"]).collect()[0]["roc_auc"]
    assert got == pytest.approx(wins / (len(pos) * len(neg)))
    one = df.filter("label = 1")
    assert models.roc_auc(one, ["model"]).collect()[0]["roc_auc"] is None


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([("m", 0, 0), ("m", 0, 0)], "model string, label int, prediction int")
    row = models.confusion_metrics(df, ["model"]).collect()[0]
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_scaler_constant_column(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "a double, b double")
    rows = sorted(tuple(r) for r in models.standardize(df, ["a", "b"]).collect())
    assert rows == [(0.0, -1.0), (0.0, 1.0)]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101])
def test_split_sizes(spark, n):
    df = spark.range(n).withColumn("y", (F.col("id") % 2 == 0).cast("int"))
    parts = models.stratified_split(df, "y", "id").groupBy("y", "part").count().collect()
    sizes = {(r["y"], r["part"]): r["count"] for r in parts}
    for y, size in ((1, (n + 1) // 2), (0, n // 2)):
        test = math.ceil(size * 0.2)
        val = math.ceil((size - test) * 0.2)
        assert sizes.get((y, "test"), 0) == test
        assert sizes.get((y, "validation"), 0) == val
        assert sizes.get((y, "train"), 0) == size - test - val


@pytest.mark.parametrize("rank", [0, 1, 17, 399, 400, 600, 1098, 1099, 1100])
def test_row_at_rank(spark, monkeypatch, rank):
    """Many rounds with few splitters, one value with a third of all rows, strings and times."""
    monkeypatch.setattr(ordering, "SPLITTERS", 5)
    monkeypatch.setattr(ordering, "FINAL_ROWS", 20)
    rows = [("hot", "2020-01-01 00:00:00.5")] * 400 + [
        (f"k{i % 9}", f"2021-03-{1 + i % 28:02} 10:00:{i % 60:02}") for i in range(700)
    ]
    df = spark.createDataFrame(rows, "name string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = ordering.row_at_rank(df, ["name", "at"], rank)
    assert got == (list(sorted(rows)[rank]) if rank < len(rows) else None)


@pytest.mark.parametrize("by", ["ticker", "date"])
@pytest.mark.parametrize("fraction", [0.0, 0.7, 1.0])
def test_ordered_split(spark, by, fraction):
    frame = pd.DataFrame(
        {
            "ticker": ["HOT"] * 40 + ["A"] * 5 + ["Z"] * 5,
            "date": list(pd.date_range("2020-01-01", periods=40)) + list(pd.date_range("2020-01-03", periods=5)) * 2,
        }
    )
    df = spark.createDataFrame(frame).withColumn("date", F.col("date").cast("timestamp_ntz"))
    first, rest = drift.ordered_split(df, fraction, by=by)
    keys = ["ticker", "date"] if by == "ticker" else ["date", "ticker"]
    ordered = [tuple(r) for r in frame.sort_values(keys)[["ticker", "date"]].itertuples(index=False)]
    cut = int(len(ordered) * fraction)
    got = sorted((r["ticker"], pd.Timestamp(r["date"])) for r in first.collect())
    assert got == sorted(ordered[:cut]) and rest.count() == len(ordered) - cut


def samples(spark, heavy):
    rng = np.random.default_rng(1)
    make = lambda n, lo, hi, m, s: pd.DataFrame(
        {"rsi_14": rng.uniform(lo, hi, n), "macd": rng.normal(0, 1, n), "sma_20": rng.normal(m, s, n),
         "target": rng.integers(0, 2, n)})
    old = make(200, 20, 80, 30, 5)
    new = make(100, 85, 99, 200, 10) if heavy else make(80, 20, 80, 30, 5)
    return spark.createDataFrame(old), spark.createDataFrame(new)


def test_heavy_and_similar_samples(spark):
    columns = ["rsi_14", "macd", "sma_20", "target"]
    heavy = drift.drift_summary(drift.drift_table(*samples(spark, True), columns)).collect()[0]
    assert heavy["drift_detected"] and heavy["alert_level"] == "red"
    assert set(heavy["features_drifted"]) >= {"rsi_14", "sma_20"}
    tests = {"rsi_14": "ks", "macd": "ks", "sma_20": "ks", "target": "z"}
    table = drift.drift_table(*samples(spark, False), columns, tests=tests)
    similar = drift.drift_summary(table).collect()[0]
    assert similar["overall_drift_score"] < 1.0 and set(similar["drift_scores"]) == set(columns)


def test_number_of_rows_does_not_change_the_test(spark):
    columns = ["rsi_14", "macd", "sma_20", "target"]
    old, new = samples(spark, False)
    tenfold = [df.crossJoin(spark.range(10).select(F.lit(1).alias("_x"))).drop("_x") for df in (old, new)]
    small, large = (
        {r["column"]: (r["test"], round(r["score"], 9)) for r in drift.drift_table(*pair, columns).collect()}
        for pair in ((old, new), tenfold)
    )
    assert small == large and set(t for t, _ in small.values()) == {"wasserstein"}


def test_ks_against_ecdf(spark):
    old, new = samples(spark, False)
    a, b = old.toPandas()["macd"].to_numpy(), new.toPandas()["macd"].to_numpy()
    grid = np.sort(np.concatenate([a, b]))
    ecdf = lambda v: np.searchsorted(np.sort(v), grid, side="right") / len(v)
    got = drift.drift_ks(old, new, ["macd"]).collect()[0]
    assert got["ks_d"] == pytest.approx(np.abs(ecdf(a) - ecdf(b)).max())
    w = np.sum(np.abs(ecdf(a) - ecdf(b))[:-1] * np.diff(grid))
    got = drift.drift_wasserstein(old, new, ["macd"]).collect()[0]
    assert got["w1"] == pytest.approx(w) and got["wasserstein"] == pytest.approx(w / a.std())


def test_alert_levels(spark):
    df = spark.createDataFrame([(0.0,), (0.19,), (0.2,), (0.49,), (0.5,), (1.0,)], "s double")
    got = [r[0] for r in df.orderBy("s").select(drift.alert_level(F.col("s"))).collect()]
    assert got == ["green", "green", "yellow", "yellow", "red", "red"]


def test_chi_square_tail():
    assert _chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert _chi2_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert _chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert _chi2_tail(0.0, 3) == 1.0 and _chi2_tail(float("inf"), 3) == 0.0


def test_constant_column(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "x double")
    bins = timeseries.histogram(df, ["x"]).collect()
    assert [(r["bin"], r["n"]) for r in bins] == [(0, 5)]
    table = drift.drift_table(df, df, ["x"]).collect()[0]
    assert not table["drifted"]
