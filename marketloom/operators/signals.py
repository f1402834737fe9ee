"""Rules an analyst applies to prices and indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.features import latest_per_key
from marketloom.operators.indicators import add_indicators
from marketloom.operators.ordering import running_totals

# Period name -> calendar span as (months, days); None means no limit.
PERIODS = {
    "1d": (0, 1), "5d": (0, 5), "1mo": (1, 0), "3mo": (3, 0), "6mo": (6, 0), "1y": (12, 0),
    "2y": (24, 0), "5y": (60, 0), "10y": (120, 0), "max": None,
}
MIN_ROWS = 50

# Texts of the recommendation, prediction, confidence and position.
BUY_STRONG = "COMPRA FORTE - Alta probabilidade de valorização"
SELL_STRONG = "VENDA FORTE - Alta probabilidade de desvalorização"
BUY = "COMPRA - Probabilidade moderada de valorização"
SELL = "VENDA - Probabilidade moderada de desvalorização"
NEUTRAL = "NEUTRO - Incerteza alta, aguardar melhores sinais"
UP, DOWN = "valorização", "desvalorização"
HIGH, MODERATE, LOW = "alta", "moderada", "baixa"
ABOVE, BELOW = "acima", "abaixo"
MODEL_NAME, RULE_NAME = "LSTM", "Technical Indicators (Fallback)"


def period_filter(bars: DataFrame, period: str, key: str = "ticker") -> DataFrame:
    """Bars of the last ``period`` up to the last bar of the table; ``ytd`` is its calendar year."""
    if period not in PERIODS and period != "ytd":
        raise ValueError(f"unknown period {period!r}")
    last = bars.agg(F.max("date")).scalar()
    if period == "ytd":
        return bars.filter(F.col("date") >= F.date_trunc("year", last).cast("timestamp_ntz"))
    if PERIODS[period] is None:
        return bars
    months, days = PERIODS[period]
    start = last - F.make_interval(months=F.lit(months), days=F.lit(days))
    return bars.filter(F.col("date") > start)


def price_summary(bars: DataFrame, period: str = "1mo") -> DataFrame:
    """First and last close, extremes, mean volume and change per ticker over the period."""
    sums = (
        period_filter(bars, period)
        .groupBy("ticker")
        .agg(
            F.max_by("close", "date").alias("_now"),
            F.min_by("close", "date").alias("_start"),
            F.max("high").alias("_high"),
            F.min("low").alias("_low"),
            F.avg("volume").alias("_volume"),
            F.count(F.lit(1)).alias("data_points"),
        )
    )
    change = F.col("_now") - F.col("_start")
    return sums.select(
        "ticker",
        F.lit(period).alias("period"),
        F.bround("_now", 2).alias("current_price"),
        F.bround("_start", 2).alias("start_price"),
        F.bround("_high", 2).alias("high_price"),
        F.bround("_low", 2).alias("low_price"),
        F.bround(change, 2).alias("price_change"),
        F.bround(F.try_divide(change, F.col("_start")) * 100, 2).alias("price_change_pct"),
        F.col("_volume").cast("long").alias("avg_volume"),
        "data_points",
    )


def compare_stocks(bars: DataFrame, period: str = "1mo", tickers: list[str] | None = None) -> DataFrame:
    """Summaries ranked by change, best first; equal changes keep the order of ``tickers``.

    Ranks come from running counts over ranges of the order, so no task holds all tickers. Tickers
    without data give no row.
    """
    if tickers:
        bars = bars.filter(F.col("ticker").isin(tickers))
        position = F.array_position(F.array(*[F.lit(t) for t in tickers]), F.col("ticker"))
    else:
        position = F.col("ticker")
    summary = price_summary(bars, period).withColumn("_position", position)
    change = F.col("price_change_pct")
    order = F.struct(change.isNull().alias("none"), (-change).alias("change"), F.col("_position"))
    ranked = running_totals(
        summary.withColumns({"_order": order, "_one": F.lit(1)}), [], "_order", ["_one"]
    )
    rank, size = F.col("cum__one"), F.col("total__one")
    return ranked.select(
        *[c for c in summary.columns if c != "_position"],
        rank.cast("long").alias("rank"), (rank == 1).alias("is_best"), (rank == size).alias("is_worst"),
    )


def indicator_snapshot(bars: DataFrame, period: str = "3mo", min_rows: int = MIN_ROWS) -> DataFrame:
    """Last indicators per ticker over the period; tickers with too few bars get ``error``."""
    recent = period_filter(bars, period)
    size = recent.groupBy("ticker").agg(F.count(F.lit(1)).alias("data_points"))
    last = latest_per_key(
        add_indicators(recent).select(
            "ticker", "date", "close", "rsi_14", "sma_20", "sma_50", "ema_12", "ema_26", "macd",
            "bb_upper", "bb_middle", "bb_lower",
        )
    )
    enough = F.col("data_points") >= min_rows
    signal = interpret(F.col("rsi_14"), F.col("close"), F.col("sma_20"), F.col("sma_50"))
    numbers = {"current_price": "close"} | {
        c: c for c in ("rsi_14", "sma_20", "sma_50", "ema_12", "ema_26", "macd", "bb_upper",
                       "bb_middle", "bb_lower")
    }
    return last.join(size, "ticker").select(
        "ticker",
        "data_points",
        *[F.when(enough, F.bround(c, 2)).alias(name) for name, c in numbers.items()],
        F.when(enough, signal).alias("signal"),
        F.when(~enough, F.concat(F.lit("Insufficient data for "), "ticker")).alias("error"),
    )


def interpret(rsi: Column, price: Column, sma_20: Column, sma_50: Column) -> Column:
    """Text on RSI and trend; bounds are strict."""
    momentum = (
        F.when(rsi > 70, "overbought").when(rsi < 30, "oversold").otherwise("neutral RSI")
    )
    trend = (
        F.when((price > sma_20) & (sma_20 > sma_50), "bullish trend")
        .when((price < sma_20) & (sma_20 < sma_50), "bearish trend")
        .otherwise("mixed trend")
    )
    return F.concat_ws(", ", momentum, trend)


def rule_points(rsi: Column, price: Column, sma_20: Column, sma_50: Column) -> Column:
    """Signed points of momentum and trend as a struct (bullish, bearish)."""
    momentum = F.when(rsi < 30, 2).when(rsi > 70, -2).when(rsi > 50, 1).otherwise(-1)
    trend = (
        F.when((price > sma_20) & (sma_20 > sma_50), 2)
        .when((price < sma_20) & (sma_20 < sma_50), -2)
        .when(price > sma_20, 1)
        .otherwise(-1)
    )

    def part(sign: int) -> Column:
        return (
            F.greatest(momentum * sign, F.lit(0)) + F.greatest(trend * sign, F.lit(0))
        ).cast("long")

    return F.struct(part(1).alias("bullish"), part(-1).alias("bearish"))


def recommend(prediction: Column, probability: Column) -> Column:
    """Recommendation text from the class and the probability of a rise."""
    up = prediction == 1
    return (
        F.when(probability > 0.7, F.when(up, BUY_STRONG).otherwise(SELL_STRONG))
        .when(probability > 0.6, F.when(up, BUY).otherwise(SELL))
        .otherwise(NEUTRAL)
    )


def side_of(price: Column, mean: Column) -> Column:
    return F.when(price > mean, ABOVE).otherwise(BELOW)


def decision_columns(probability: Column, prediction: Column, confidence: Column, model: str) -> list:
    """Columns of a decision, the same for the model and for the rules."""
    return [
        F.when(prediction == 1, UP).otherwise(DOWN).alias("prediction"),
        F.bround(probability * 100, 2).alias("probability_up"),
        F.bround((1 - probability) * 100, 2).alias("probability_down"),
        confidence.alias("confidence"),
        F.lit(model).alias("model"),
        recommend(prediction, probability).alias("recommendation"),
    ]


def rule_score(snapshot: DataFrame) -> DataFrame:
    """Decision from the rounded indicators of a snapshot; rows with an error are left out."""
    rsi, price = F.col("rsi_14"), F.col("current_price")
    sma_20, sma_50 = F.col("sma_20"), F.col("sma_50")
    scored = (
        snapshot.filter(F.col("error").isNull())
        .withColumn("_points", rule_points(rsi, price, sma_20, sma_50))
        .withColumns({"bullish": F.col("_points.bullish"), "bearish": F.col("_points.bearish")})
    )
    total = F.col("bullish") + F.col("bearish")
    scored = scored.withColumn("_p", F.coalesce(F.try_divide("bullish", total), F.lit(0.5)))
    p = F.col("_p")
    confidence = F.when(F.abs(p - 0.5) > 0.15, MODERATE).otherwise(LOW)
    return scored.select(
        "ticker", "bullish", "bearish",
        *decision_columns(p, (p > 0.5).cast("int"), confidence, RULE_NAME),
        side_of(price, sma_20).alias("price_vs_sma20"),
        side_of(price, sma_50).alias("price_vs_sma50"),
    )


def model_decision(predictions: DataFrame) -> DataFrame:
    """Decision from model output (ticker, prediction, probability of a rise)."""
    p = F.col("probability")
    confidence = F.when(F.abs(p - 0.5) > 0.2, HIGH).otherwise(MODERATE)
    return predictions.select(
        "ticker", *decision_columns(p, F.col("prediction"), confidence, MODEL_NAME)
    )


def decide(snapshot: DataFrame, predictions: DataFrame) -> DataFrame:
    """The model's decision where there is one, else the decision by rules."""
    columns = ["prediction", "probability_up", "probability_down", "confidence", "model",
               "recommendation"]
    model = model_decision(predictions).select("ticker", F.struct(*columns).alias("_model"))
    rules = rule_score(snapshot).select("ticker", F.struct(*columns).alias("_rules"))
    both = rules.join(model, "ticker", "full").withColumn("_d", F.coalesce("_model", "_rules"))
    return both.select("ticker", *[F.col(f"_d.{c}").alias(c) for c in columns])


def prediction_band(probability: Column) -> Column:
    """buy above 0.6, sell below 0.4, else neutral."""
    return F.when(probability > 0.6, "buy").when(probability < 0.4, "sell").otherwise("neutral")


def signed_percent(value: Column) -> Column:
    """Two decimals with an explicit sign."""
    sign = F.when(value >= 0, "+").otherwise("-")
    return F.concat(sign, F.format_string("%.2f", F.abs(value)), F.lit("%"))


def analysis_text(summary: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One line of text per ticker with price, change, range, RSI, signal, MACD and means."""
    # a null would be printed as text, so it is replaced before formatting
    shown = {
        c: F.when(F.col(c).isNull(), "N/A").otherwise(F.format_string("%.2f", F.col(c)))
        for c in ("rsi_14", "macd", "sma_20", "sma_50")
    }
    joined = summary.join(snapshot.drop("current_price", "data_points"), "ticker", "left")
    money = {c: F.format_string("%.2f", F.col(c)) for c in ("current_price", "low_price", "high_price")}
    text = F.concat_ws(
        " | ",
        F.concat(F.lit("Análise de "), "ticker"),
        F.concat(F.lit("Cotação Atual: R$ "), money["current_price"]),
        F.concat(F.lit("Variação: "), signed_percent(F.col("price_change_pct"))),
        F.concat(F.lit("Preço: R$ "), money["low_price"], F.lit(" - R$ "), money["high_price"]),
        F.concat(F.lit("RSI (14): "), shown["rsi_14"], F.lit(" - "),
                 F.coalesce("signal", F.lit("N/A"))),
        F.concat(F.lit("MACD: "), shown["macd"]),
        F.concat(F.lit("SMA20: R$ "), shown["sma_20"]),
        F.concat(F.lit("SMA50: R$ "), shown["sma_50"]),
    )
    return joined.select("ticker", text.alias("analysis"))
