"""The end-to-end jobs: features from stored bars, and drift between stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import contracts
from marketloom.functions.columns import feature_columns
from marketloom.operators.drift import DriftConfig, drift_summary, drift_table, ordered_split
from marketloom.operators.indicators import HORIZON, add_indicators, drop_nulls, with_tail
from marketloom.sources.tables import read_parquet, write_json, write_parquet

DRIFT_SCHEMA = (
    "drift_detected boolean, overall_drift_score double, alert_level string, "
    "features_drifted array<string>, drift_scores map<string,double>"
)


def feature_job(
    spark: SparkSession, source: str, target: str, horizon: int = HORIZON, tail: str = "zero"
) -> DataFrame:
    """Bars at ``source`` to the training table at ``target``; returns its row counts.

    Bars must meet the raw contract. Indicators and label are added, rows with a null (the warm-up
    of a series) are dropped, the result must meet the training contract and is written. One row
    comes back: ticker count, ``rows_read``, ``rows_dropped``, ``rows_written``.
    """
    bars = contracts.validate(read_parquet(spark, source), contracts.RAW)
    labelled = with_tail(add_indicators(bars, horizon), tail).drop("close_future")
    write_parquet(drop_nulls(labelled), target)
    written = read_parquet(spark, target)
    contracts.validate(written, contracts.TRAINING)
    read = bars.agg(F.count(F.lit(1)).alias("rows_read"), F.count_distinct("ticker").alias("tickers"))
    kept = written.agg(F.count(F.lit(1)).alias("rows_written")).scalar()
    return read.select(
        "tickers", "rows_read", (F.col("rows_read") - kept).alias("rows_dropped"),
        kept.alias("rows_written"),
    )


def drift_job(
    spark: SparkSession, reference: str, result: str, current: str | None = None,
    columns: list[str] | None = None, tests: dict[str, str] | None = None,
    config: DriftConfig = DriftConfig(),
) -> DataFrame:
    """Compare two stored tables and store the summary as JSON at ``result``; returns it.

    Without ``current`` the reference is split by date, 70 to 30. The columns are by default all
    numeric features and the target, where both tables have them.
    """
    old = read_parquet(spark, reference)
    if current is None:
        old, new = ordered_split(old, by="date")
    else:
        new = read_parquet(spark, current)
    if columns is None:
        found = feature_columns(old, exclude=("date", "ticker"))
        columns = [c for c in found if c in new.columns]
    write_json(drift_summary(drift_table(old, new, columns, config, tests), config), result)
    return spark.read.schema(DRIFT_SCHEMA).json(result)
