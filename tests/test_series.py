"""Indicators on long, short and uneven series against pandas; blocks must not show."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import indicators as ind
from marketloom.operators import series, timeseries


def walk(ticker, n, seed, freq="D", start="2000-01-01"):
    rng = np.random.default_rng(seed)
    close = np.round(50 + np.cumsum(rng.normal(0, 1, n)), 2)
    close = np.abs(close) + 5
    return pd.DataFrame(
        {
            "date": pd.date_range(start, periods=n, freq=freq), "ticker": ticker,
            "open": close + 0.1, "high": close + rng.uniform(0.1, 2, n),
            "low": close - rng.uniform(0.1, 2, n), "close": close,
            "volume": rng.integers(1, 1000, n),
        }
    )


@pytest.fixture(scope="module")
def bars():
    """One series holds most rows; others are short, or have long gaps."""
    gaps = walk("GAP", 120, 3, freq="300D", start="1980-01-01")
    return pd.concat(
        [walk("HOT", 5000, 1), walk("MID", 300, 2), gaps, walk("ONE", 1, 4), walk("TEN", 10, 5)],
        ignore_index=True,
    )


def to_spark(spark, frame):
    df = spark.createDataFrame(frame).withColumn("date", F.col("date").cast("timestamp_ntz"))
    return df.repartition(4)


def expected(group):
    g = group.sort_values("date").copy()
    close = g["close"]
    for n in (5, 10, 20, 50):
        g[f"sma_{n}"] = close.rolling(n).mean()
    g["ema_12"] = close.ewm(span=12, adjust=False).mean()
    g["ema_26"] = close.ewm(span=26, adjust=False).mean()
    delta = close.diff()
    gain = delta.where(delta > 0, 0).rolling(14).mean()
    loss = (-delta).where(delta < 0, 0).rolling(14).mean()
    g["rsi_14"] = 100 - 100 / (1 + gain / loss)
    g["macd"] = g["ema_12"] - g["ema_26"]
    g["macd_signal"] = g["macd"].ewm(span=9, adjust=False).mean()
    g["macd_histogram"] = g["macd"] - g["macd_signal"]
    g["bb_middle"] = close.rolling(20).mean()
    dev = close.rolling(20).std()
    g["bb_upper"], g["bb_lower"] = g["bb_middle"] + 2 * dev, g["bb_middle"] - 2 * dev
    g["bb_width"] = (g["bb_upper"] - g["bb_lower"]) / g["bb_middle"]
    prev = close.shift()
    tr = pd.concat([g["high"] - g["low"], (g["high"] - prev).abs(), (g["low"] - prev).abs()], axis=1)
    g["atr_14"] = tr.max(axis=1).rolling(14).mean()
    g["obv"] = (np.sign(delta).fillna(0) * g["volume"]).cumsum()
    g["volume_ma_20"] = g["volume"].rolling(20).mean()
    g["price_change"], g["price_change_5d"] = close.pct_change(), close.pct_change(5)
    g["target"] = (close.shift(-5) > close).astype(int)
    return g


@pytest.mark.parametrize("block_rows", [series.BLOCK_ROWS, 64])
def test_all_indicators(spark, bars, block_rows, monkeypatch):
    monkeypatch.setattr(ind, "BLOCK_ROWS", block_rows)
    got = ind.add_indicators(to_spark(spark, bars), horizon=5).toPandas()
    want = pd.concat([expected(g) for _, g in bars.groupby("ticker")])
    both = got.merge(want, on=["ticker", "date"], suffixes=("", "_want"))
    assert len(got) == len(both) == len(bars)
    for c in [*ind.INDICATOR_COLUMNS, "target"]:
        np.testing.assert_allclose(
            both[c].astype(float), both[f"{c}_want"].astype(float), rtol=1e-9, atol=1e-9, err_msg=c
        )


@pytest.mark.parametrize("spans", [[2, 200], [1, 5, 9], [12.5]])
def test_ema_of_far_apart_spans(spark, bars, spans):
    got = ind.ema(to_spark(spark, bars), spans).toPandas()
    for ticker, g in bars.groupby("ticker"):
        mine = got[got.ticker == ticker].sort_values("date")
        for s in spans:
            want = g.sort_values("date")["close"].ewm(span=s, adjust=False).mean()
            np.testing.assert_allclose(mine[f"ema_{s:g}"], want, rtol=1e-12)


def test_macd_of_far_apart_spans(spark, bars):
    spans = (3, 2000, 9)
    got = ind.macd(to_spark(spark, bars), spans).toPandas().sort_values("date")
    for ticker, g in bars.groupby("ticker"):
        close = g.sort_values("date")["close"]
        line = close.ewm(span=3, adjust=False).mean() - close.ewm(span=2000, adjust=False).mean()
        mine = got[got.ticker == ticker]
        np.testing.assert_allclose(mine["macd"], line, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(
            mine["macd_signal"], line.ewm(span=9, adjust=False).mean(), rtol=1e-9, atol=1e-9
        )


def test_first_price_of_any_size_still_counts(spark, bars):
    one = bars[bars.ticker == bars.ticker.iloc[0]].sort_values("date").copy()
    one.loc[one.index[0], "close"] = 1e30
    got = ind.ema(to_spark(spark, one), [26]).toPandas().sort_values("date")
    want = one["close"].ewm(span=26, adjust=False).mean()
    np.testing.assert_allclose(got["ema_26"], want, rtol=1e-9)


def test_position_over_many_stretches(spark, bars):
    got = series.with_position(to_spark(spark, bars), days=30).toPandas()
    for _, g in got.groupby("ticker"):
        assert list(g.sort_values("date")[series.POSITION]) == list(range(len(g)))


def test_sequences(spark, bars):
    frame = bars.assign(target=(bars.index % 2).astype("int64"))
    got = ind.sequences(to_spark(spark, frame), ["close", "volume"], 60).toPandas()
    sizes = got.groupby("ticker").size().to_dict()
    assert sizes == {"HOT": 4940, "MID": 240, "GAP": 60}
    hot = frame[frame.ticker == "HOT"].reset_index(drop=True)
    row = got[(got.ticker == "HOT") & (got.date == hot.date[2100])].iloc[0]
    assert [s[0] for s in row.sequence] == list(hot.close[2040:2100])
    assert row.label == hot.target[2100]


def flat(spark, closes, volumes=None):
    frame = walk("T", len(closes), 0)
    frame["close"] = [float(c) for c in closes]
    frame["high"], frame["low"] = frame["close"] + 1, frame["close"] - 1
    if volumes is not None:
        frame["volume"] = volumes
    return to_spark(spark, frame)


def column(df, name):
    return [r[0] for r in df.orderBy("date").select(name).collect()]


def test_rsi_rules(spark):
    rising = column(ind.rsi(flat(spark, range(1, 31))), "rsi_14")
    assert rising[:13] == [None] * 13 and rising[13:] == [100.0] * 17
    assert column(ind.rsi(flat(spark, [5] * 20)), "rsi_14") == [None] * 20
    falling = column(ind.rsi(flat(spark, range(30, 0, -1))), "rsi_14")
    assert falling[13:] == [0.0] * 17


def test_obv_and_true_range(spark):
    df = flat(spark, [10, 11, 11, 9], [100, 20, 30, 40])
    assert column(ind.obv(df), "obv") == [0.0, 20.0, 20.0, -20.0]
    assert column(ind.true_range(df), "true_range") == [2.0, 2.0, 2.0, 3.0]


def test_change_from_zero_is_infinite(spark):
    got = column(ind.returns(flat(spark, [0, 5, 0, -3])), "price_change")
    assert got[0] is None and got[1] == float("inf") and got[2] == -1.0 and got[3] == float("-inf")


def test_target_tail(spark):
    df = flat(spark, range(1, 9))
    assert column(ind.add_target(df, 5), "target") == [1, 1, 1, 0, 0, 0, 0, 0]
    assert column(ind.add_target(df, 5, tail="drop"), "target") == [1, 1, 1]
    with pytest.raises(ValueError):
        ind.add_target(df, 5, tail="keep")


def test_training_table_keeps_the_tail(spark, bars):
    got = ind.training_table(to_spark(spark, bars)).groupBy("ticker").count().collect()
    assert {r["ticker"]: r["count"] for r in got} == {"HOT": 4951, "MID": 251, "GAP": 71}


def test_pacf_against_yule_walker(spark, bars):
    got = timeseries.pacf(to_spark(spark, bars[bars.ticker == "MID"]), max_lag=5).toPandas()
    x = bars[bars.ticker == "MID"]["close"].to_numpy()
    x = x - x.mean()
    r = [float((x[k:] * x[: len(x) - k]).sum() / (x * x).sum()) for k in range(6)]
    phi1 = r[1]
    phi2 = (r[2] - r[1] ** 2) / (1 - r[1] ** 2)
    values = got.sort_values("lag")["pacf"].tolist()
    np.testing.assert_allclose(values[:3], [1.0, phi1, phi2], rtol=1e-9)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_holds_a_series(spark, bars):
    plan = plan_of(ind.add_indicators(to_spark(spark, bars)))
    assert "SinglePartition" not in plan
    assert "hashpartitioning(ticker#" in plan and "_block#" in plan
    # windows over rows are partitioned by block or stretch; only the sums over blocks are not
    windows = [line for line in plan.splitlines() if "Window [" in line and "[ticker#" in line]
    alone = [line for line in windows if "_block" not in line and "_stretch" not in line]
    assert not alone
