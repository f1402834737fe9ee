"""Stored column profiles that merge: counts, moments and a quantile sketch per period.

A day's profile is built once from its rows. Descriptions and drift over any span of days come from
merging a few small rows, so the reference need not be read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.drift import SHARE_FLOOR
from marketloom.operators.ordering import long_form

SKETCH_SIZE = 1600  # k of the KLL sketches
RANK_ERROR = 0.005  # a quantile is off by at most this share of the rows, with a chance above 0.99
GRID = 500  # quantiles of each side through which two distributions are compared


def profile(df: DataFrame, columns: list[str], period: str | None = None) -> DataFrame:
    """(period, column, n, mean, m2, low, high, sketch): one row per period and column.

    Nulls and NaN are left out; a column without any number in a period has no row there. ``period``
    is a column of ``df`` (null: all rows are one period). Partial sketches merge on the map side.
    """
    of = F.col(period) if period is not None else F.lit(None).cast("string")
    numbers = df.select(of.alias("period"), *[F.col(c).cast("double").alias(c) for c in columns])
    values = numbers.unpivot(["period"], columns, "column", "value").filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    return values.groupBy("period", "column").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count(F.lit(1))).alias("m2"),
        F.min("value").alias("low"), F.max("value").alias("high"),
        F.kll_sketch_agg_double("value", F.lit(SKETCH_SIZE)).alias("sketch"),
    )


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """One row per column for all periods of ``profiles``: (column, n, mean, m2, low, high, sketch)."""
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    return profiles.groupBy("column").agg(
        n.alias("n"), mean.alias("mean"),
        F.greatest(
            F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean, F.lit(0.0)
        ).alias("m2"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def _quantiles(sketch: Column, probs: Sequence[float]) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(float(p)) for p in probs]))


def describe_profiles(profiles: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, count, mean, std, min, max, quantiles) over all periods; quantiles within ``RANK_ERROR``.

    ``quantiles`` are values of the data in the order of ``probs``. ``std`` is the sample deviation,
    null for a single number.
    """
    merged = merge_profiles(profiles)
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return merged.select(
        "column", F.col("n").alias("count"), "mean", std.alias("std"), F.col("low").alias("min"),
        F.col("high").alias("max"), _quantiles(F.col("sketch"), probs).alias("quantiles"),
    )


def profile_drift(reference: DataFrame, current: DataFrame, buckets: int = 10) -> DataFrame:
    """(column, psi, ks) of two sets of profiles, for the columns that both have.

    PSI takes the reference's quantile edges and floors shares at ``SHARE_FLOOR``; KS is the greatest
    distance at the quantiles of both sides. Shares are within ``RANK_ERROR + 1 / GRID`` of the exact
    ones, the KS distance within twice that.
    """
    sides = merge_profiles(reference).alias("r").join(merge_profiles(current).alias("c"), "column")
    edges = [i / buckets for i in range(1, buckets)]
    grid = [i / GRID for i in range(1, GRID + 1)]
    placed = sides.select(
        "column", _quantiles(F.col("r.sketch"), grid).alias("r"), _quantiles(F.col("c.sketch"), grid).alias("c"),
        F.array_distinct(_quantiles(F.col("r.sketch"), edges)).alias("edges"),
    ).withColumn("at", F.array_union("r", "c"))

    def shares(side: str, points: str) -> Column:
        """Share of a side's numbers up to each point, from the number of its quantiles there."""
        return F.transform(points, lambda v: F.size(F.filter(side, lambda q: q <= v)) / GRID)

    at = placed.select(
        "column", shares("r", "at").alias("ra"), shares("c", "at").alias("ca"),
        F.concat(F.array(F.lit(0.0)), shares("r", "edges"), F.array(F.lit(1.0))).alias("re"),
        F.concat(F.array(F.lit(0.0)), shares("c", "edges"), F.array(F.lit(1.0))).alias("ce"),
    )

    def parts(ends: str) -> Column:
        return F.transform(
            F.slice(ends, 2, 1 << 20),
            lambda e, i: F.greatest(e - F.get(ends, i), F.lit(SHARE_FLOOR)),
        )

    psi = F.aggregate(
        F.zip_with(parts("ce"), parts("re"), lambda c, r: (c - r) * F.log(c / r)), F.lit(0.0), lambda a, v: a + v
    )
    ks = F.array_max(F.zip_with("ra", "ca", lambda r, c: F.abs(r - c)))
    return at.select("column", psi.alias("psi"), ks.alias("ks"))


def rank_errors(df: DataFrame, columns: list[str], described: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(column, prob, error): distance of each described quantile's share from ``prob`` in the rows.

    A value that many rows share covers a range of shares; inside it the error is 0.
    """
    asked = described.select("column", F.posexplode("quantiles").alias("i", "q"))
    values = long_form(df, columns).join(F.broadcast(asked), "column")
    share = values.groupBy("column", "i").agg(
        (F.count_if(F.col("value") < F.col("q")) / F.count(F.lit(1))).alias("below"),
        (F.count_if(F.col("value") <= F.col("q")) / F.count(F.lit(1))).alias("upto"),
    )
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1)
    error = F.greatest(F.col("below") - prob, prob - F.col("upto"), F.lit(0.0))
    return share.select("column", prob.alias("prob"), error.alias("error"))
