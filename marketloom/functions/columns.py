"""Choice and description of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns that identify a row or label it.
ID_COLUMNS = ("date", "ticker", "target")
FEATURE_KINDS = ("double", "float", "bigint", "int")


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = ID_COLUMNS) -> list[str]:
    """Numeric columns that are neither key nor label; known from the schema, without a scan."""
    return [c for c, kind in df.dtypes if kind in FEATURE_KINDS and c not in exclude]


def describe_features(df: DataFrame, exclude: tuple[str, ...] = ID_COLUMNS) -> DataFrame:
    """(position, feature, type, n_values, least, greatest) of the feature columns of all rows."""
    kinds = dict(df.dtypes)
    features = feature_columns(df, exclude)
    filled = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(i).cast("long").alias("position"), F.lit(c).alias("feature"),
                    F.lit(kinds[c]).alias("type"), F.count(c).alias("n_values"),
                    F.min(F.col(c).cast("double")).alias("least"),
                    F.max(F.col(c).cast("double")).alias("greatest"),
                )
                for i, c in enumerate(features)
            ]
        ).alias("_f")
    )
    return filled.select(F.inline("_f"))


def class_distribution(df: DataFrame, target: str = "target") -> DataFrame:
    """Rows and share per class."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.col("n") / total)
