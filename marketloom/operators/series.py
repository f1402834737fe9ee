"""Ordered work inside a key (a price series per ticker) without one task per key.

A plain ``Window.partitionBy("ticker")`` sends a whole series to one task. Here every row first
gets its position in its series, from row counts per (key, stretch of time); then the series is cut
into blocks of equal length and the few rows before and after a block that a trailing or leading
frame can reach are copied into it. All frames are then exact inside a block, and a task holds one
block, however long the series is.

Rows must be unique per (key, order); this is the contract of a bar table, and it bounds the rows
per stretch by its length over the bar interval.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

POSITION = "_pos"
BLOCK = "_block"
STRETCH = "_stretch"

DAY = 86_400
STRETCH_DAYS = 2048  # time covered by one stretch: at most 2048 daily bars, or 49,152 hourly bars
BLOCK_ROWS = 1024  # own rows per block


def stretch_of(order: str, days: float = STRETCH_DAYS) -> Column:
    """Number of the stretch of time that the timestamp column ``order`` falls into."""
    return F.floor(F.unix_seconds(F.col(order).cast("timestamp")) / F.lit(int(days * DAY)))


TIME_LEVELS = ["_day", "_minute", "_second"]


def with_time_levels(df: DataFrame, order: str, days: float = STRETCH_DAYS) -> DataFrame:
    """Add the stretch, day, minute and second of ``order``: levels of a search for a rank."""
    at = F.unix_seconds(F.col(order).cast("timestamp"))
    return df.withColumns(
        {
            STRETCH: stretch_of(order, days), "_day": F.floor(at / DAY), "_minute": F.floor(at / 60),
            "_second": at,
        }
    )


def with_position(
    df: DataFrame, key: str = "ticker", order: str = "date", days: float = STRETCH_DAYS
) -> DataFrame:
    """Add ``_pos``, the 0-based position of each row in its series.

    The count per (key, stretch) combines on the map side; the running sum over stretches works on
    one row per stretch. The rows shuffle once, by (key, stretch).
    """
    rows = df.withColumn(STRETCH, stretch_of(order, days))
    earlier = Window.partitionBy(key).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(key, STRETCH)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(key, STRETCH, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    local = F.row_number().over(Window.partitionBy(key, STRETCH).orderBy(order)) - 1
    return (
        rows.withColumn("_local", local)
        .join(starts, [key, STRETCH])
        .withColumn(POSITION, F.col("_start") + F.col("_local"))
        .drop("_start", "_local", STRETCH)
    )


def spread_blocks(
    df: DataFrame, before: int, after: int = 0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Copy each positioned row to every block whose frames may reach it; adds ``_block``.

    A frame of ``before`` rows back and ``after`` rows ahead is exact for the block's own rows.
    """
    first = F.greatest(F.floor((F.col(POSITION) - after) / block_rows), F.lit(0))
    last = F.floor((F.col(POSITION) + before) / block_rows)
    return df.withColumn(BLOCK, F.explode(F.sequence(first, last)))


def is_own(block_rows: int = BLOCK_ROWS) -> Column:
    """True for the copy of a row in the block it belongs to."""
    return F.floor(F.col(POSITION) / block_rows) == F.col(BLOCK)


def own_rows(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Keep one copy of each row."""
    return df.filter(is_own(block_rows))


def over_series(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int,
    after: int = 0,
    key: str = "ticker",
    order: str = "date",
    block_rows: int = BLOCK_ROWS,
    days: float = STRETCH_DAYS,
    keep_block: bool = False,
) -> DataFrame:
    """Run ``build(rows, window)`` block by block and return the own rows of each block.

    ``window`` is partitioned by (key, block) and ordered by position. ``build`` adds columns; its
    frames must stay within ``before`` rows back and ``after`` rows ahead.
    """
    placed = df if POSITION in df.columns else with_position(df, key, order, days)
    blocks = spread_blocks(placed, before, after, block_rows)
    window = Window.partitionBy(key, BLOCK).orderBy(POSITION)
    built = own_rows(build(blocks, window), block_rows)
    if not keep_block:
        built = built.drop(BLOCK)
    return built if POSITION in df.columns else built.drop(POSITION)
