"""Bars, indicators, labels and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import incremental as inc
from marketloom.operators import indicators as ind
from marketloom.plans.registry import query
from marketloom.plans.tables import (
    BARS_SQL,
    HOURLY_SQL,
    daily_bars,
    ema_sql,
    hourly_bars,
    rounded,
    stored_bars,
)
from marketloom.session import work_path

W = "PARTITION BY ticker ORDER BY date"


def _mean(n: int, value: str = "close", name: str | None = None) -> str:
    frame = f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"CASE WHEN count({value}) OVER {frame} >= {n} THEN avg({value}) OVER {frame} END"
        + (f" AS {name}" if name else "")
    )


def _dev(n: int) -> str:
    frame = f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) OVER {frame} >= {n} THEN stddev_samp(close) OVER {frame} END"


MACD_SQL = f"""
WITH RECURSIVE {BARS_SQL}, {ema_sql([12, 26])},
lines AS (SELECT ticker, date, rn, ema_12 - ema_26 AS macd, ema_12, ema_26 FROM ema),
sig AS (
  SELECT ticker, date, rn, macd, ema_12, ema_26, macd AS macd_signal FROM lines WHERE rn = 1
  UNION ALL
  SELECT l.ticker, l.date, l.rn, l.macd, l.ema_12, l.ema_26,
         0.2::DOUBLE * l.macd + 0.8::DOUBLE * s.macd_signal
  FROM sig s JOIN lines l ON l.ticker = s.ticker AND l.rn = s.rn + 1)"""

RSI_SQL = f"""
moves AS (
  SELECT *, coalesce(close - lag(close) OVER ({W}), 0) AS delta FROM bars),
parts AS (
  SELECT *, {_mean(14, 'greatest(delta, 0)', 'gain')}, {_mean(14, 'greatest(-delta, 0)', 'loss')}
  FROM moves),
rsi AS (
  SELECT ticker, date, CASE WHEN loss = 0 AND gain > 0 THEN 100.0 WHEN loss = 0 THEN NULL
         ELSE 100 - 100 / (1 + gain / loss) END AS rsi_14 FROM parts)"""

TR_SQL = f"""
ranges AS (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER ({W})),
                     abs(low - lag(close) OVER ({W}))) AS true_range FROM bars)"""

OBV_SQL = f"""
signed AS (
  SELECT *, CAST(sign(coalesce(close - lag(close) OVER ({W}), 0)) AS BIGINT) * volume AS sv
  FROM bars),
obv AS (SELECT ticker, date, CAST(sum(sv) OVER ({W}) AS DOUBLE) AS obv FROM signed)"""

BAND = f"""
bands AS (
  SELECT ticker, date, {_mean(20, name='mid')}, 2 * ({_dev(20)}) AS dev FROM bars),
bollinger AS (
  SELECT ticker, date, mid + dev AS bb_upper, mid AS bb_middle, mid - dev AS bb_lower,
         ((mid + dev) - (mid - dev)) / mid AS bb_width FROM bands)"""

INDICATOR_SQL = f"""
{MACD_SQL}, {RSI_SQL}, {TR_SQL}, {OBV_SQL}, {BAND},
means AS (
  SELECT *, {', '.join(_mean(n, name=f'sma_{n}') for n in (5, 10, 20, 50))},
         {_mean(20, 'volume', 'volume_ma_20')},
         close / lag(close) OVER ({W}) - 1 AS price_change,
         close / lag(close, 5) OVER ({W}) - 1 AS price_change_5d,
         {_mean(14, 'true_range', 'atr_14')}
  FROM ranges),
indicators AS (
  SELECT t.date, t.ticker, open, high, low, close, volume, sma_5, sma_10, sma_20, sma_50, ema_12,
         ema_26, rsi_14, macd, macd_signal, macd - macd_signal AS macd_histogram, bb_upper,
         bb_middle, bb_lower, bb_width, atr_14, obv, volume_ma_20, price_change, price_change_5d
  FROM means t JOIN sig USING (ticker, date) JOIN rsi USING (ticker, date)
  JOIN obv USING (ticker, date) JOIN bollinger USING (ticker, date))"""

NUMBERS = ["open", "high", "low", "close", *ind.INDICATOR_COLUMNS]
ROUNDED = ", ".join(f"round({c}, 4) AS {c}" for c in NUMBERS)


@query("ohlcv_bars", f"WITH {BARS_SQL} SELECT * FROM bars")
def q_bars(spark, sf):
    return daily_bars(spark, sf)


@query("hourly_bars", f"WITH {HOURLY_SQL} SELECT * FROM hourly")
def q_hourly(spark, sf):
    return hourly_bars(spark, sf)


@query(
    "sma",
    f"""WITH {BARS_SQL} SELECT ticker, date,
    {', '.join(f'round({_mean(n)}, 4) AS sma_{n}' for n in (5, 10, 20, 50))} FROM bars""",
)
def q_sma(spark, sf):
    out = ind.sma(stored_bars(spark, sf))
    return rounded(out.select("ticker", "date", "sma_5", "sma_10", "sma_20", "sma_50"))


@query(
    "trend_overlay",
    f"""WITH {BARS_SQL} SELECT ticker, date, close,
    {', '.join(f'round({_mean(n)}, 4) AS sma_{n}' for n in (21, 50))} FROM bars""",
)
def q_trend(spark, sf):
    out = ind.sma(stored_bars(spark, sf), [21, 50])
    return rounded(out.select("ticker", "date", "close", "sma_21", "sma_50"))


@query(
    "ema",
    f"""WITH RECURSIVE {BARS_SQL}, {ema_sql([3, 12, 26, 200])}
    SELECT ticker, date, round(ema_3, 4) AS ema_3, round(ema_12, 4) AS ema_12,
           round(ema_26, 4) AS ema_26, round(ema_200, 4) AS ema_200 FROM ema""",
)
def q_ema(spark, sf):
    out = ind.ema(stored_bars(spark, sf), [3, 12, 26, 200])
    return rounded(out.select("ticker", "date", "ema_3", "ema_12", "ema_26", "ema_200"))


@query(
    "first_difference",
    f"""WITH {BARS_SQL} SELECT ticker, date,
    round(close - lag(close) OVER ({W}), 4) AS variation,
    round((close / lag(close) OVER ({W}) - 1) * 100, 4) AS variation_pct FROM bars""",
)
def q_difference(spark, sf):
    out = ind.difference(ind.returns(stored_bars(spark, sf)), alias="variation")
    out = out.withColumn("variation_pct", F.col("price_change") * 100)
    return rounded(out.select("ticker", "date", "variation", "variation_pct"))


@query(
    "rsi",
    f"WITH {BARS_SQL}, {RSI_SQL} SELECT ticker, date, round(rsi_14, 4) AS rsi_14 FROM rsi",
)
def q_rsi(spark, sf):
    return rounded(ind.rsi(stored_bars(spark, sf)).select("ticker", "date", "rsi_14"))


@query(
    "macd",
    f"""{MACD_SQL} SELECT ticker, date, round(macd, 4) AS macd,
    round(macd_signal, 4) AS macd_signal, round(macd - macd_signal, 4) AS macd_histogram
    FROM sig""",
)
def q_macd(spark, sf):
    out = ind.macd(stored_bars(spark, sf))
    return rounded(out.select("ticker", "date", "macd", "macd_signal", "macd_histogram"))


@query(
    "bollinger",
    f"""WITH {BARS_SQL}, {BAND} SELECT ticker, date, round(bb_upper, 4) AS bb_upper,
    round(bb_middle, 4) AS bb_middle, round(bb_lower, 4) AS bb_lower,
    round(bb_width, 4) AS bb_width FROM bollinger""",
)
def q_bollinger(spark, sf):
    out = ind.bollinger(stored_bars(spark, sf))
    return rounded(out.select("ticker", "date", "bb_upper", "bb_middle", "bb_lower", "bb_width"))


@query(
    "true_range",
    f"WITH {BARS_SQL}, {TR_SQL} SELECT ticker, date, round(true_range, 4) AS true_range FROM ranges",
)
def q_true_range(spark, sf):
    return rounded(ind.true_range(stored_bars(spark, sf)).select("ticker", "date", "true_range"))


@query(
    "atr",
    f"""WITH {BARS_SQL}, {TR_SQL} SELECT ticker, date,
    round({_mean(14, 'true_range')}, 4) AS atr_14 FROM ranges""",
)
def q_atr(spark, sf):
    return rounded(ind.atr(stored_bars(spark, sf)).select("ticker", "date", "atr_14"))


@query("obv", f"WITH {BARS_SQL}, {OBV_SQL} SELECT ticker, date, obv FROM obv")
def q_obv(spark, sf):
    return ind.obv(stored_bars(spark, sf)).select("ticker", "date", "obv")


@query(
    "volume_ma",
    f"""WITH {BARS_SQL} SELECT ticker, date,
    round({_mean(20, 'volume')}, 4) AS volume_ma_20 FROM bars""",
)
def q_volume_ma(spark, sf):
    return rounded(ind.volume_ma(stored_bars(spark, sf)).select("ticker", "date", "volume_ma_20"))


@query(
    "returns",
    f"""WITH {BARS_SQL} SELECT ticker, date,
    round(close / lag(close) OVER ({W}) - 1, 6) AS price_change,
    round(close / lag(close, 5) OVER ({W}) - 1, 6) AS price_change_5d FROM bars""",
)
def q_returns(spark, sf):
    out = ind.returns(stored_bars(spark, sf))
    return rounded(out.select("ticker", "date", "price_change", "price_change_5d"), 6)


@query("indicators", f"{INDICATOR_SQL} SELECT date, ticker, volume, {ROUNDED} FROM indicators")
def q_indicators(spark, sf):
    return rounded(ind.add_indicators(stored_bars(spark, sf)))


@query(
    "indicators_incremental",
    f"{INDICATOR_SQL} SELECT date, ticker, volume, {ROUNDED} FROM indicators",
)
def q_indicators_incremental(spark, sf):
    """Three runs by date; every 37th day of two tickers comes late, with the last run."""
    bars = stored_bars(spark, sf)
    late = F.col("ticker").isin("1-URGENT", "5-LOW") & (F.dayofyear("date") % 37 == 0)
    part = F.when(late | (F.col("date") >= "1997-01-01"), 2).when(F.col("date") >= "1995-01-01", 1).otherwise(0)
    folder = work_path(spark, "incremental")
    for run in range(3):
        inc.update_indicators(spark, folder, bars.filter(part == run), run)
    return rounded(inc.read_indicators(spark, folder, 3))


TARGET = f"""CASE WHEN lead(close, 5) OVER ({W}) > close THEN 1 ELSE 0 END::BIGINT AS target"""


@query("target", f"WITH {BARS_SQL} SELECT ticker, date, {TARGET} FROM bars")
def q_target(spark, sf):
    return ind.add_target(stored_bars(spark, sf)).select("ticker", "date", "target")


@query(
    "target_closed_tail",
    f"""WITH {BARS_SQL}, t AS (SELECT ticker, date, {TARGET}, lead(close, 5) OVER ({W}) AS ahead
    FROM bars) SELECT ticker, date, target FROM t WHERE ahead IS NOT NULL""",
)
def q_target_closed(spark, sf):
    out = ind.add_target(stored_bars(spark, sf), tail="drop")
    return out.select("ticker", "date", "target")


@query(
    "training_table",
    f"""{INDICATOR_SQL}, labelled AS (SELECT *, {TARGET} FROM indicators)
    SELECT date, ticker, volume, target, {ROUNDED} FROM labelled
    WHERE {' AND '.join(f'{c} IS NOT NULL' for c in NUMBERS)}""",
)
def q_training(spark, sf):
    return rounded(ind.training_table(stored_bars(spark, sf)))


SEQUENCE_SQL = f"""
WITH {BARS_SQL}, labelled AS (SELECT *, {TARGET} FROM bars),
windows AS (
  SELECT ticker, date, target AS label,
         list([close, volume::DOUBLE]) OVER ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS s
  FROM labelled)
SELECT ticker, date, label, len(s)::BIGINT AS steps,
       array_to_string(list_transform(s, lambda x: CAST(round(x[1] * 100) AS BIGINT) || '/' ||
                                                   CAST(x[2] AS BIGINT)), ',') AS sequence
FROM windows WHERE len(s) = 60"""


@query("sequences", SEQUENCE_SQL)
def q_sequences(spark, sf):
    labelled = ind.add_target(stored_bars(spark, sf))
    out = ind.sequences(labelled, ["close", "volume"], 60)
    text = F.transform(
        "sequence",
        lambda x: F.concat_ws("/", F.round(x[0] * 100).cast("long"), x[1].cast("long")),
    )
    return out.select(
        "ticker", "date", "label", F.size("sequence").cast("long").alias("steps"),
        F.array_join(text, ",").alias("sequence"),
    )
