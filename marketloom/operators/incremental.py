"""Indicators kept up to date: every run reads its new bars and one carry per ticker.

Below a folder each run has its own part: ``bars/run=k`` (what came), ``rows/run=k`` (the indicators
of these bars), ``carries/run=k`` (per ticker of the run the state after its last bar). A run is done
when its carries are; a run that is repeated writes the same parts again.

A bar at or before the last one of its ticker is late (or corrects one). Its ticker is replayed from
the newest carry before that bar that no later run has made stale: the bars since then are read
again, with the newest run's version of each, and their indicators are written anew. Other tickers
of the run do not read old bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.operators.indicators import (
    BAR_COLUMNS,
    EMA_SPANS,
    INDICATOR_COLUMNS,
    REACH,
    continued_indicators,
)
from marketloom.operators.series import POSITION
from marketloom.session import stage
from marketloom.sources.tables import exists

BARS_SCHEMA = (
    "ticker string, date timestamp_ntz, open double, high double, low double, close double, volume bigint"
)
_MEANS = [f"ema_{s}" for s in EMA_SPANS]
CARRY_SCHEMA = (
    "ticker string, since timestamp_ntz, date timestamp_ntz, "
    + ", ".join(f"{c} double" for c in [*_MEANS, "macd_signal"])
    + ", obv bigint, tail array<struct<date: timestamp_ntz, open: double, high: double, low: double, "
    "close: double, volume: bigint>>"
)
ROWS_SCHEMA = BARS_SCHEMA + ", " + ", ".join(f"{c} double" for c in INDICATOR_COLUMNS)


def _part(folder: str, kind: str, run: int) -> str:
    return f"{folder}/{kind}/run={run}"


def is_done(spark: SparkSession, folder: str, run: int) -> bool:
    return exists(spark, f"{_part(folder, 'carries', run)}/_SUCCESS")


def _read(spark: SparkSession, folder: str, kind: str, schema: str, before: int) -> DataFrame:
    """All parts of the runs before ``before``, with the column ``run``."""
    whole = spark.read.schema(f"{schema}, run int").parquet(f"{folder}/{kind}")
    return whole.filter(F.col("run") < before)


def _usable(carries: DataFrame) -> DataFrame:
    """Carries that no later run of their ticker has made stale by bars at or before their date."""
    later = Window.partitionBy("ticker").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    newest = Window.partitionBy("ticker")
    return (
        carries.withColumn("_since", F.min("since").over(later))
        .withColumn("_newest", F.max("run").over(newest))
        .filter(F.col("_since").isNull() | (F.col("_since") > F.col("date")))
        .drop("_since")
    )


def update_indicators(spark: SparkSession, folder: str, bars: DataFrame, run: int) -> None:
    """Add the ``bars`` of run number ``run``; the runs before it must be done.

    ``bars`` are unique per (ticker, date); columns beyond the bar's are left out. Runs are numbered
    from 0. A run without bars writes empty parts. Repeating the last run replaces it.
    """
    if run > 0 and not is_done(spark, folder, run - 1):
        raise ValueError(f"run {run - 1} is not done under {folder}")
    bars.select("ticker", *BAR_COLUMNS).write.mode("overwrite").parquet(_part(folder, "bars", run))
    new = spark.read.schema(BARS_SCHEMA).parquet(_part(folder, "bars", run))
    firsts = new.groupBy("ticker").agg(F.min("date").alias("since"))
    if run == 0:
        carry = spark.createDataFrame([], CARRY_SCHEMA)
    else:
        new, carry, firsts = _continued(spark, folder, run, new, firsts)
    rows = continued_indicators(new, carry)
    rows.select("ticker", *BAR_COLUMNS, *INDICATOR_COLUMNS, POSITION).write.mode("overwrite").parquet(
        _part(folder, "rows", run)
    )
    done = spark.read.schema(f"{ROWS_SCHEMA}, {POSITION} bigint").parquet(_part(folder, "rows", run))
    _carries(done, carry, firsts).write.mode("overwrite").parquet(_part(folder, "carries", run))


def _continued(
    spark: SparkSession, folder: str, run: int, new: DataFrame, firsts: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The bars to compute, the carries they follow, and the first bar that came per ticker."""
    usable = _usable(_read(spark, folder, "carries", CARRY_SCHEMA, run))
    asked = usable.join(firsts.withColumnRenamed("since", "_first"), "ticker").filter(
        F.col("date") < F.col("_first")
    )
    others = [c for c in asked.columns if c not in ("ticker", "_first")]
    carry = stage(
        asked.groupBy("ticker").agg(F.max_by(F.struct(*others), "run").alias("_c")).select("ticker", "_c.*"),
        "carries",
    )
    newest = usable.groupBy("ticker").agg(F.max("_newest").alias("_last"))
    stale = stage(
        newest.join(firsts, "ticker", "left_semi")
        .join(carry.select("ticker", "run", "date"), "ticker", "left")
        .filter(F.col("run").isNull() | (F.col("run") < F.col("_last")))
        .select("ticker", F.coalesce("run", F.lit(-1)).alias("_from"), F.col("date").alias("_after")),
        "late_tickers",
    )
    least = stale.agg(F.min("_from").alias("run")).first().run
    if least is None:  # nothing late: no old bar is read
        return new, carry, firsts
    old = _read(spark, folder, "bars", BARS_SCHEMA, run).filter(F.col("run") > least)
    replayed = old.join(stale, "ticker").filter(
        F.col("_after").isNull() | (F.col("date") > F.col("_after"))
    )
    bar = F.struct(*[c for c in BAR_COLUMNS if c != "date"])
    every = replayed.select("ticker", *BAR_COLUMNS, "run").unionByName(
        new.select("ticker", *BAR_COLUMNS, F.lit(run).alias("run"))
    )
    whole = every.groupBy("ticker", "date").agg(F.max_by(bar, "run").alias("_b")).select("ticker", "date", "_b.*")
    return stage(whole.select("ticker", *BAR_COLUMNS), "replayed_bars"), carry, firsts


def _carries(rows: DataFrame, carry: DataFrame, firsts: DataFrame) -> DataFrame:
    """State per ticker after its last row; at most ``REACH`` bars of a ticker are gathered."""
    last = rows.groupBy("ticker").agg(
        F.max("date").alias("date"), F.max(POSITION).alias("_end"),
        *[F.max_by(c, "date").alias(c) for c in [*_MEANS, "macd_signal", "obv"]],
    ).withColumn("obv", F.col("obv").cast("long"))
    own = rows.join(last.select("ticker", "_end"), "ticker").filter(F.col(POSITION) > F.col("_end") - REACH)
    bars = own.select("ticker", F.struct(*BAR_COLUMNS).alias("bar")).unionByName(
        carry.join(firsts, "ticker", "left_semi").select("ticker", F.explode("tail").alias("bar"))
    )
    tails = bars.groupBy("ticker").agg(F.sort_array(F.collect_list("bar")).alias("tail"))
    cut = F.slice("tail", F.greatest(F.size("tail") - REACH + 1, F.lit(1)), REACH)
    return last.join(tails, "ticker").join(firsts, "ticker").select(
        "ticker", "since", "date", *_MEANS, "macd_signal", "obv", cut.alias("tail")
    )


def read_indicators(spark: SparkSession, folder: str, runs: int) -> DataFrame:
    """The indicators after the first ``runs`` runs: of each (ticker, date) the newest run's row."""
    rows = _read(spark, folder, "rows", ROWS_SCHEMA, runs)
    rest = [*BAR_COLUMNS[1:], *INDICATOR_COLUMNS]
    newest = rows.groupBy("ticker", "date").agg(F.max_by(F.struct(*rest), "run").alias("_r"))
    return newest.select("ticker", "date", "_r.*")
