"""Drift between a reference and a current sample, column by column."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.stats import chi2_pvalue, ks_pvalue, normal_pvalue
from marketloom.operators.ordering import (
    long_form,
    quantiles_of_totals,
    row_at_rank,
    running_totals,
)

# Floors and shares of the tests.
MIN_DEVIATION = 0.001
SHARE_FLOOR = 1e-4
DATASET_SHARE = 0.5

P_VALUE_TESTS = ("z", "chi2", "ks")  # a low score is drift
DISTANCE_TESTS = ("jensenshannon", "wasserstein")  # a high score is drift


@dataclass(frozen=True)
class DriftConfig:
    """Thresholds; override single values with ``dataclasses.replace``."""

    green_threshold: float = 0.20
    yellow_threshold: float = 0.50
    stattest_threshold: float = 0.05


def value_counts(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, r, c): rows per value in each sample; combines on the map side."""
    sides = long_form(reference, columns).select("column", "value", F.lit(1).alias("r"), F.lit(0).alias("c"))
    sides = sides.unionByName(
        long_form(current, columns).select("column", "value", F.lit(0).alias("r"), F.lit(1).alias("c"))
    )
    return sides.groupBy("column", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))


def value_totals(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts with exact running totals per column, stored once for all measures."""
    return running_totals(value_counts(reference, current, columns), ["column"], "value", ["r", "c"])


def _moments(totals: DataFrame) -> DataFrame:
    """Reference mean per column, for the deviation about it."""
    return totals.groupBy("column").agg(
        F.try_divide(F.sum(F.col("value") * F.col("r")), F.sum("r")).alias("_mean")
    )


def measures(totals: DataFrame) -> DataFrame:
    """One row per column with the statistics of all tests but PSI.

    ks_d, wasserstein (W1 over the reference deviation), chi2 with its degrees of freedom, js
    (Jensen-Shannon distance of value shares) and z (two proportions of the greater value).
    """
    f_r = F.col("cum_r") / F.col("total_r")
    f_c = F.col("cum_c") / F.col("total_c")
    p, q = F.col("r") / F.col("total_r"), F.col("c") / F.col("total_c")
    m = (p + q) / 2
    expected = F.col("r") * F.col("total_c") / F.col("total_r")
    gap = F.abs(f_r - f_c)

    def half_kl(share: Column) -> Column:
        return F.when(share > 0, share * F.ln(share / m)).otherwise(0.0)

    rows = totals.join(F.broadcast(_moments(totals)), "column")  # a row per column, here and below
    chi = F.when(expected > 0, (F.col("c") - expected) ** 2 / expected).when(
        F.col("c") > 0, F.lit(float("inf"))
    ).otherwise(0.0)
    sums = rows.groupBy("column").agg(
        F.max("total_r").alias("n_reference"),
        F.max("total_c").alias("n_current"),
        F.count(F.lit(1)).alias("n_values"),
        F.max(gap).alias("ks_d"),
        F.sum(gap * (F.coalesce("next_value", "value") - F.col("value"))).alias("w1"),
        F.sqrt(F.sum(F.col("r") * (F.col("value") - F.col("_mean")) ** 2) / F.max("total_r")).alias(
            "std_reference"
        ),
        F.sum(chi).alias("chi2"),
        F.sqrt(F.greatest(F.sum(half_kl(p) + half_kl(q)) / 2, F.lit(0.0))).alias("js"),
        F.max_by(p, "value").alias("_pr"),
        F.max_by(q, "value").alias("_pc"),
    )
    n_r, n_c = F.col("n_reference"), F.col("n_current")
    pooled = (F.col("_pr") * n_r + F.col("_pc") * n_c) / (n_r + n_c)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n_r + 1 / n_c))
    return sums.withColumns(
        {
            "wasserstein": F.col("w1") / F.greatest("std_reference", F.lit(MIN_DEVIATION)),
            "chi2_dof": F.col("n_values") - 1,
            "z": F.try_divide(F.col("_pr") - F.col("_pc"), error),
        }
    ).drop("_pr", "_pc")


def drift_ks(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance with its asymptotic p-value."""
    out = measures(value_totals(reference, current, columns))
    p = ks_pvalue(F.col("ks_d"), F.col("n_reference"), F.col("n_current"))
    return out.select("column", "ks_d", p.alias("p_value"))


def drift_wasserstein(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """W1 distance over the reference deviation."""
    return measures(value_totals(reference, current, columns)).select("column", "w1", "wasserstein")


def _category_counts(
    reference: DataFrame, current: DataFrame, columns: list[str]
) -> DataFrame:
    """(column, value, r, c) for columns of any type, values as strings."""

    def side(df: DataFrame, r: int, c: int) -> DataFrame:
        texts = df.select(*[F.col(x).cast("string").alias(x) for x in columns])
        return (
            texts.unpivot([], columns, "column", "value").filter("value IS NOT NULL")
            .select("column", "value", F.lit(r).alias("r"), F.lit(c).alias("c"))
        )

    both = side(reference, 1, 0).unionByName(side(current, 0, 1))
    return both.groupBy("column", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))


def _with_totals(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("column").agg(
        F.sum("r").alias("total_r"), F.sum("c").alias("total_c")
    )
    return counts.join(F.broadcast(totals), "column")


def drift_chi2(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Chi-square of current counts against counts expected from the reference shares."""
    expected = F.col("r") * F.col("total_c") / F.col("total_r")
    term = F.when(expected > 0, (F.col("c") - expected) ** 2 / expected).when(
        F.col("c") > 0, F.lit(float("inf"))
    ).otherwise(0.0)
    out = _with_totals(_category_counts(reference, current, columns)).groupBy("column").agg(
        F.sum(term).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof")
    )
    return out.withColumn("p_value", chi2_pvalue("chi2", "dof"))


def drift_js(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Jensen-Shannon distance (natural logarithm) of the value shares."""
    p, q = F.col("r") / F.col("total_r"), F.col("c") / F.col("total_c")
    m = (p + q) / 2

    def half_kl(share: Column) -> Column:
        return F.when(share > 0, share * F.ln(share / m)).otherwise(0.0)

    distance = F.sqrt(F.greatest(F.sum(half_kl(p) + half_kl(q)) / 2, F.lit(0.0)))
    counts = _with_totals(_category_counts(reference, current, columns))
    return counts.groupBy("column").agg(distance.alias("js"))


def drift_z(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """z-test of the share of the greater value of a binary column."""
    out = measures(value_totals(reference, current, columns))
    return out.select("column", "z", normal_pvalue("z").alias("p_value"))


def drift_psi(
    reference: DataFrame, current: DataFrame, columns: list[str], buckets: int = 10
) -> DataFrame:
    """Population stability index over buckets between the reference quantiles."""
    totals = value_totals(reference, current, columns)
    probs = [i / buckets for i in range(1, buckets)]
    # at most buckets-1 edges per column
    edges = (
        quantiles_of_totals(totals, "r", probs)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list("quantile")).alias("_edges"))
    )
    bucket = F.size(F.filter("_edges", lambda e: e <= F.col("value")))
    per_bucket = (
        totals.join(F.broadcast(edges), "column")
        .groupBy("column", bucket.alias("bucket"))
        .agg(
            (F.sum("r") / F.max("total_r")).alias("p"), (F.sum("c") / F.max("total_c")).alias("q")
        )
    )
    p = F.greatest("p", F.lit(SHARE_FLOOR))
    q = F.greatest("q", F.lit(SHARE_FLOOR))
    return per_bucket.groupBy("column").agg(F.sum((p - q) * F.ln(p / q)).alias("psi"))


def default_tests(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Test per column by its declared kind: distances that mean the same at any number of rows."""
    measured = ("double", "float", "bigint", "int", "smallint", "tinyint")
    kinds = dict(df.dtypes)
    return {
        c: "wasserstein" if kinds[c] in measured or kinds[c].startswith("decimal") else "jensenshannon"
        for c in columns
    }


def drift_table(
    reference: DataFrame, current: DataFrame, columns: list[str],
    config: DriftConfig = DriftConfig(), tests: dict[str, str] | None = None,
) -> DataFrame:
    """One row per column: its test, the score and the flag.

    ``tests`` names the test of a column; the others take the default of their kind. The number of
    rows or values never changes the test.
    """
    named = {**default_tests(reference, columns), **(tests or {})}
    unknown = set(named.values()) - {*P_VALUE_TESTS, *DISTANCE_TESTS}
    if unknown or set(named) - set(columns):
        raise ValueError(f"unknown tests {sorted(unknown)} or columns {sorted(set(named) - set(columns))}")
    out = measures(value_totals(reference, current, columns))
    pairs = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    test = F.element_at(pairs, F.col("column"))
    # equal constant columns have no test statistic: nothing moved
    z_p = F.coalesce(normal_pvalue("z"), F.lit(1.0))
    score = (
        F.when(test == "z", z_p)
        .when(test == "chi2", chi2_pvalue("chi2", "chi2_dof"))
        .when(test == "ks", ks_pvalue(F.col("ks_d"), F.col("n_reference"), F.col("n_current")))
        .when(test == "jensenshannon", F.col("js"))
        .otherwise(F.col("wasserstein"))
    )
    limit = config.stattest_threshold
    scored = out.select("column", test.alias("test"), score.alias("score"))
    is_pvalue = F.col("test").isin(*P_VALUE_TESTS)
    drifted = F.when(is_pvalue, F.col("score") < limit).otherwise(F.col("score") >= limit)
    return scored.withColumn("drifted", drifted)


def alert_level(score: Column, config: DriftConfig = DriftConfig()) -> Column:
    return (
        F.when(score < config.green_threshold, "green")
        .when(score < config.yellow_threshold, "yellow")
        .otherwise("red")
    )


def drift_summary(drift: DataFrame, config: DriftConfig = DriftConfig()) -> DataFrame:
    """One row: share of drifted columns, dataset flag, level, drifted names and scores by name."""
    out = drift.agg(
        F.avg(F.col("drifted").cast("double")).alias("overall_drift_score"),
        F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("column")))).alias(
            "features_drifted"
        ),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "score")))).alias(
            "drift_scores"
        ),
    )
    share = F.col("overall_drift_score")
    return out.select(
        (share >= DATASET_SHARE).alias("drift_detected"), "overall_drift_score",
        alert_level(share, config).alias("alert_level"), "features_drifted", "drift_scores",
    )


def ordered_split(
    df: DataFrame, fraction: float = 0.7, by: str = "ticker", key: str = "ticker",
    order: str = "date",
) -> tuple[DataFrame, DataFrame]:
    """First ``floor(fraction * n)`` rows in order, and the rest; (key, order) must be unique.

    ``by="ticker"`` orders by (key, order), the order of the stored file; ``by="date"`` orders by
    (order, key). The row at the cut is found by counts between drawn splitters; its two values come
    to the driver, so that both parts are plain filters, which reach the scan.
    """
    pair = [key, order] if by == "ticker" else [order, key]
    rows = df.select(*pair)
    cut = row_at_rank(rows, pair, math.floor(rows.count() * fraction))
    if cut is None:
        return df, df.filter(F.lit(False))
    kinds = dict(df.dtypes)
    first, second = (F.lit(value).cast(kinds[c]) for c, value in zip(pair, cut))
    outer, inner = (F.col(c) for c in pair)
    before = (outer < first) | ((outer == first) & (inner < second))
    return df.filter(before), df.filter(~before)
