"""Bar tables: aggregation of ticks, reshaping of vendor downloads, column selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of a bar table, in order.
BAR_COLUMNS = ["date", "ticker", "open", "high", "low", "close", "volume"]
PRICE_FIELDS = ["open", "high", "low", "close", "volume"]


def ohlcv_bars(
    ticks: DataFrame,
    ticker: Column,
    ts: Column,
    price: Column,
    sequence: Column,
    interval: str = "day",
    volume: Column | None = None,
    tickers: list[str] | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Open, high, low, close and volume per (ticker, interval).

    ``sequence`` orders ticks inside a bar and must be unique there. Bars cover ``[start, end)``.
    Everything combines on the map side, so a ticker or a day with very many ticks costs no more
    shuffle than any other.
    """
    rows = ticks.select(
        ticker.alias("ticker"), ts.alias("ts"), price.alias("price"), sequence.alias("seq"),
        (F.lit(1) if volume is None else volume).cast("long").alias("qty"),
    )
    if tickers:
        rows = rows.filter(F.col("ticker").isin(tickers))
    if start:
        rows = rows.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        rows = rows.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    return (
        rows.groupBy(F.date_trunc(interval, "ts").cast("timestamp_ntz").alias("date"), "ticker")
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("qty").alias("volume"),
        )
    )


def ticker_list(text: Column) -> Column:
    """``"a, b ,,c"`` to the array of trimmed, non-empty names."""
    return F.filter(F.transform(F.split(text, ","), lambda name: F.trim(name)), lambda name: name != "")


def wide_to_long(wide: DataFrame, separator: str = "|", date: str = "date") -> DataFrame:
    """Vendor layout (one column per ``field|ticker``) to one row per (date, ticker).

    Only fields that exist are returned; a (date, ticker) without any value gives no row. The
    columns of a date become an array of structs that is exploded, so nothing is shuffled.
    """
    pairs = [c.split(separator, 1) for c in wide.columns if separator in c]
    names = list(dict.fromkeys(ticker for _, ticker in pairs))
    present = {(field.lower(), ticker): f"`{field}{separator}{ticker}`" for field, ticker in pairs}
    fields = [f for f in PRICE_FIELDS if any((f, t) in present for t in names)]
    kinds = {f: "bigint" if f == "volume" else "double" for f in fields}
    blocks = [
        F.struct(
            F.lit(ticker).alias("ticker"),
            *[
                (F.col(present[f, ticker]) if (f, ticker) in present else F.lit(None))
                .cast(kinds[f]).alias(f)
                for f in fields
            ],
        )
        for ticker in names
    ]
    long = wide.select(date, F.inline(F.array(*blocks)))
    return long.na.drop("all", subset=fields)


def single_ticker(download: DataFrame, ticker: str) -> DataFrame:
    """Download of one ticker: lower-case names plus the constant ticker column."""
    return standard_columns(
        download.toDF(*[c.lower() for c in download.columns]).withColumn("ticker", F.lit(ticker))
    )


def standard_columns(df: DataFrame) -> DataFrame:
    """The bar columns that exist, in their fixed order; names compare in lower case."""
    lower = df.withColumnsRenamed({c: c.lower() for c in df.columns})
    return lower.select([c for c in BAR_COLUMNS if c in lower.columns])


def ingest_stats(bars: DataFrame) -> DataFrame:
    """Rows, number of tickers, first and last date."""
    return bars.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("ticker").alias("n_tickers"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
