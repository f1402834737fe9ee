"""The test tables in the shapes that the operators expect, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import stage
from marketloom.sources.bars import ohlcv_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table for work that is heavy per row.

    It is read as it is stored. A session whose files are too few to keep its cores busy may ask for
    a number of parts (``spark.marketloom.text.parts``), which costs one shuffle of the texts.
    """
    df = table(spark, sf_dir, name)
    parts = spark.conf.get("spark.marketloom.text.parts", None)
    return df.repartition(int(parts)) if parts else df


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ticks: one ticker per priority, price = order total, volume = number of orders."""
    orders = table(spark, sf_dir, "orders")
    return ohlcv_bars(
        orders,
        ticker=F.col("o_orderpriority"),
        ts=F.col("o_orderdate"),
        price=F.col("o_totalprice"),
        sequence=F.col("o_orderkey"),
    )


def stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars as the stored table that ingestion leaves behind."""
    return stage(daily_bars(spark, sf_dir), "bars")


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: one ticker per event type."""
    return ohlcv_bars(
        table(spark, sf_dir, "events"),
        ticker=F.col("event_type"),
        ts=F.col("ts"),
        price=F.col("value"),
        sequence=F.col("ts"),
        interval="hour",
    )


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for the comparison with SQL."""
    return df.select(
        *[
            F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c)
            for c, t in df.dtypes
        ]
    )


# SQL counterpart of daily_bars(); to be placed first in a WITH list.
BARS_SQL = """
bars AS (
  SELECT o_orderdate AS date, o_orderpriority AS ticker,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
         count(*)::BIGINT AS volume
  FROM orders GROUP BY 1, 2)"""

# SQL counterpart of hourly_bars().
HOURLY_SQL = """
hourly AS (
  SELECT date_trunc('hour', ts)::TIMESTAMP AS date, event_type AS ticker,
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, count(*)::BIGINT AS volume
  FROM events GROUP BY 1, 2)"""


def ema_sql(spans: list[int], source: str = "bars", value: str = "close") -> str:
    """Recursive CTE with the exponential means of ``value``; columns ``ema_n``."""
    first = ", ".join(f"v AS ema_{s}" for s in spans)
    step = ", ".join(
        f"(2.0::DOUBLE/{s + 1})*n.v + (1-2.0::DOUBLE/{s + 1})*e.ema_{s}" for s in spans
    )
    return f"""
numbered AS (
  SELECT ticker, date, {value} AS v, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn
  FROM {source}),
ema AS (
  SELECT ticker, date, rn, {first} FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.ticker, n.date, n.rn, {step}
  FROM ema e JOIN numbered n ON n.ticker = e.ticker AND n.rn = e.rn + 1)"""


def indexed(column: str, words: list[str], modulus: int) -> Column:
    """A word chosen by ``column % modulus``; used to derive text inputs from the tables."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.col(column) % modulus + 1).cast("int"))
