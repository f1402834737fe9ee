"""Exploration of series: decomposition, unit root, autocorrelation, distributions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.text import bind
from marketloom.operators.ordering import long_form, quantiles_of_totals, running_totals
from marketloom.operators.series import POSITION, over_series, with_position

# Defaults, and Dickey-Fuller critical values (constant, large samples).
SEASON = 5
MAX_LAG = 30
BINS = 20
WHISKER = 1.5
CRITICAL = {"1%": -3.43035, "5%": -2.86154, "10%": -2.56677}


def date_range(df: DataFrame, key: str = "ticker", order: str = "date") -> DataFrame:
    return df.groupBy(key).agg(F.min(order).alias("first_date"), F.max(order).alias("last_date"))


def seasonal_decompose(df: DataFrame, value: str = "close", period: int = SEASON) -> DataFrame:
    """Additive trend (centred mean over an odd period), seasonal and residual part.

    The seasonal part is the mean of the detrended values per phase, centred to sum to zero.
    """
    if period % 2 == 0:
        raise ValueError("period must be odd")
    half = period // 2

    def build(rows: DataFrame, w) -> DataFrame:
        frame = w.rowsBetween(-half, half)
        full = F.count(value).over(frame) == period
        return rows.withColumn("trend", F.when(full, F.avg(value).over(frame)))

    placed = with_position(df.select("ticker", "date", value)).withColumn(
        "phase", F.col(POSITION) % period
    )
    trended = over_series(placed, build, before=half, after=half)
    phases = trended.groupBy("ticker", "phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_m"))
    centre = F.avg("_m").over(Window.partitionBy("ticker"))  # one row per phase
    seasonal = phases.select("ticker", "phase", (F.col("_m") - centre).alias("seasonal"))
    joined = trended.join(seasonal, ["ticker", "phase"])
    return joined.select(
        "ticker", "date", value, "trend", "seasonal",
        (F.col(value) - F.col("trend") - F.col("seasonal")).alias("residual"),
    )


def dickey_fuller(df: DataFrame, value: str = "close") -> DataFrame:
    """Unit-root statistic per ticker: regression of the difference on the previous value.

    No lagged differences. ``stationary`` tells whether the statistic lies below the 5% value.
    """
    def build(rows: DataFrame, w) -> DataFrame:
        return rows.withColumn("_x", F.lag(value).over(w))

    pairs = over_series(df.select("ticker", "date", value), build, before=1).withColumn(
        "_y", F.col(value) - F.col("_x")
    )
    sums = pairs.groupBy("ticker").agg(
        F.regr_count("_y", "_x").alias("n_obs"),
        F.regr_slope("_y", "_x").alias("_b"),
        F.regr_sxx("_y", "_x").alias("_sxx"),
        F.regr_syy("_y", "_x").alias("_syy"),
        F.regr_sxy("_y", "_x").alias("_sxy"),
    )
    rest = F.col("_syy") - F.col("_b") * F.col("_sxy")
    error = F.sqrt(F.try_divide(rest, F.col("n_obs") - 2) / F.col("_sxx"))
    statistic = F.try_divide(F.col("_b"), error)
    return sums.select(
        "ticker", "n_obs", statistic.alias("adf_statistic"),
        *[F.lit(v).alias(f"critical_{k.rstrip('%')}") for k, v in CRITICAL.items()],
        (statistic < CRITICAL["5%"]).alias("stationary"),
    )


# Response surface of the unit-root statistic with a constant. Beyond the range the
# p-value is 1 or 0; up to the switch the first polynomial holds, then the second.
TAU_RANGE = (-18.83, 2.74)
TAU_SWITCH = -1.61
TAU_LOW = (2.1659, 1.4412, 0.038269)
TAU_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_pvalue(statistic: float) -> float:
    if statistic > TAU_RANGE[1]:
        return 1.0
    if statistic < TAU_RANGE[0]:
        return 0.0
    surface = TAU_LOW if statistic <= TAU_SWITCH else TAU_HIGH
    z = sum(c * statistic**i for i, c in enumerate(surface))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def augmented_dickey_fuller(
    df: DataFrame, value: str = "close", max_lag: int = 12, lag: int | None = None
) -> DataFrame:
    """(ticker, lag, n_obs, adf_statistic, p_value): unit-root test with lagged differences.

    The difference is regressed on a constant, the previous value and ``lag`` earlier differences.
    Without ``lag`` the one of 0 to ``max_lag`` with the least AIC on the rows that all of them have
    is taken, and fitted again on all rows that it has. One pass over the rows, block by block, sums
    the cross products, apart for the first ``max_lag`` rows of a series; then at most
    ``max_lag + 1`` rows of sums per ticker are solved. Values are taken less the mean of their
    ticker, which leaves the result as it is and the sums exact enough.

    Statistic and p-value are null for a series too short for the number of terms, or constant.
    """
    if lag is not None:
        max_lag = lag
    means = df.groupBy("ticker").agg(F.avg(value).alias("_mean"))
    centred = df.select("ticker", "date", F.col(value).alias("_v")).join(means, "ticker").select(
        "ticker", "date", (F.col("_v") - F.col("_mean")).alias("_v")
    )
    names = ["_d", "_one", "_x", *[f"_d{k}" for k in range(1, max_lag + 1)]]

    def build(rows: DataFrame, w) -> DataFrame:
        rows = rows.withColumns({"_x": F.lag("_v").over(w), "_one": F.lit(1.0)})
        rows = rows.withColumn("_d", F.col("_v") - F.col("_x"))
        return rows.withColumns(
            {f"_d{k}": F.lag("_d", k).over(w) for k in range(1, max_lag + 1)}
        ) if max_lag else rows

    rows = over_series(centred, build, before=max_lag + 2).filter(F.col("_d").isNotNull())
    held = F.lit(0)
    for k in range(1, max_lag + 1):
        held = F.when(F.col(f"_d{k}").isNotNull(), k).otherwise(held)
    filled = rows.select("ticker", held.alias("_has"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = filled.groupBy("ticker", "_has").agg(
        F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in cells]).alias("sums")
    )

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        def products(at_least: int) -> np.ndarray:
            total = np.zeros((len(names), len(names)))
            for has, values in zip(frame["_has"], frame["sums"]):
                if has >= at_least:
                    for (i, j), v in zip(cells, values):
                        total[i, j] += v
            return np.triu(total) + np.triu(total, 1).T

        def fitted(total: np.ndarray, k: int) -> tuple[int, float, float]:
            """Rows, sum of squared residuals, and the statistic, with ``k`` lags."""
            terms = list(range(1, 3 + k))
            n, inner = int(round(total[1, 1])), total[np.ix_(terms, terms)]
            if n <= len(terms) or np.linalg.matrix_rank(inner) < len(terms):
                return n, math.nan, math.nan
            inverse = np.linalg.inv(inner)
            slope = inverse @ total[terms, 0]
            rest = max(total[0, 0] - slope @ total[terms, 0], 0.0)
            error = math.sqrt(rest / (n - len(terms)) * inverse[1, 1])
            return n, rest, slope[1] / error if error > 0 else math.nan

        best = lag
        if best is None:
            common = products(max_lag)
            tried = []
            for k in range(max_lag + 1):
                n, rest, _ = fitted(common, k)
                tried.append(n * math.log(rest / n) + 2 * (k + 2) if rest > 0 else math.inf)
            best = int(np.argmin(tried))
        n, _, statistic = fitted(products(best), best)
        known = not math.isnan(statistic)
        return pd.DataFrame({
            "ticker": [frame["ticker"].iloc[0]], "lag": [best], "n_obs": [n],
            "adf_statistic": [statistic if known else None],
            "p_value": [unit_root_pvalue(statistic) if known else None],
        })

    return sums.groupBy("ticker").applyInPandas(
        solve, "ticker string, lag int, n_obs bigint, adf_statistic double, p_value double"
    )


def acf(df: DataFrame, value: str = "close", max_lag: int = MAX_LAG) -> DataFrame:
    """Autocorrelation per ticker for lags 0 to ``max_lag``: one row per (ticker, lag).

    Products with all lags are summed in one pass; the sums combine on the map side.
    """
    rows = df.select("ticker", "date", value)
    means = rows.groupBy("ticker").agg(F.avg(value).alias("_mean"))
    centred = rows.join(means, "ticker").withColumn("_x", F.col(value) - F.col("_mean"))

    def build(frame: DataFrame, w) -> DataFrame:
        return frame.withColumns(
            {f"_p{k}": F.col("_x") * F.lag("_x", k).over(w) for k in range(1, max_lag + 1)}
        ).withColumn("_p0", F.col("_x") * F.col("_x"))

    products = over_series(centred.select("ticker", "date", "_x"), build, before=max_lag)
    sums = products.groupBy("ticker").agg(
        *[F.sum(f"_p{k}").alias(f"_p{k}") for k in range(max_lag + 1)]
    )
    lags = [
        F.struct(F.lit(k).cast("long").alias("lag"), F.try_divide(f"_p{k}", "_p0").alias("acf"))
        for k in range(max_lag + 1)
    ]
    return sums.select("ticker", F.inline(F.array(*lags)))


def pacf(df: DataFrame, value: str = "close", max_lag: int = MAX_LAG) -> DataFrame:
    """Partial autocorrelation per ticker and lag, by the recursion over the autocorrelations.

    With f the weights for k - 1 lags and v the variance they leave, the partial value at lag k is
    (r(k) - sum f(j) r(k - j)) / v. One array of ``max_lag`` + 1 values per ticker.
    """
    rows = acf(df, value, max_lag).groupBy("ticker").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"]).alias("r")
    )
    none = F.array().cast("array<double>")
    start = F.struct(none.alias("f"), F.lit(1.0).alias("v"), F.array(F.lit(1.0)).alias("out"))

    def step(state: Column, k: Column) -> Column:
        earlier = F.reverse(F.slice("r", F.lit(2), k - 1))
        known = F.aggregate(
            F.zip_with(state["f"], earlier, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x
        )
        partial = F.coalesce(F.try_divide(F.col("r")[k] - known, state["v"]), F.lit(0.0))

        def advanced(p: Column) -> Column:
            weights = F.zip_with(state["f"], F.reverse(state["f"]), lambda x, y: x - p * y)
            return F.struct(
                F.concat(weights, F.array(p)).alias("f"), (state["v"] * (1 - p * p)).alias("v"),
                F.concat(state["out"], F.array(p)).alias("out"),
            )

        return bind(partial, advanced)

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(max_lag)), start, step, lambda s: s["out"])
    found = rows.filter(F.col("r")[0].isNotNull()).select("ticker", F.posexplode(solved).alias("lag", "pacf"))
    return found.select("ticker", F.col("lag").cast("long").alias("lag"), "pacf")


def _totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) with running totals, stored: all that follows reads it, not the rows."""
    counts = long_form(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, ["column"], "value", ["n"])


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max: one row per column."""
    totals = _totals(df, columns)
    n, value = F.col("n"), F.col("value")
    basic = totals.groupBy("column").agg(
        F.sum(n).alias("count"), (F.sum(n * value) / F.sum(n)).alias("mean"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    away = value - F.col("mean")
    spread = totals.join(F.broadcast(basic.select("column", "mean")), "column").groupBy("column").agg(
        F.sqrt(F.try_divide(F.sum(n * away * away), F.sum(n) - 1)).alias("std")
    )
    return (
        basic.join(spread, "column").join(_quartiles(totals), "column")
        .select("column", "count", "mean", "std", "min", "max", "q25", "q50", "q75")
    )


def _quartiles(totals: DataFrame) -> DataFrame:
    at = quantiles_of_totals(totals, "n", [0.25, 0.5, 0.75])
    return at.groupBy("column").agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
            for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
        ]
    )


def histogram(df: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """Rows per equal-width bin between the least and the greatest value; the last bin is closed.

    The ends, one row per column, are broadcast: rows are counted where they are read.
    """
    values = long_form(df, columns)
    ends = values.groupBy("column").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    position = F.floor(
        F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins
    )
    placed = values.join(F.broadcast(ends), "column").withColumn(
        "bin", F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("long")
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    return (
        placed.groupBy("column", "bin", "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("column", "bin", (F.col("_lo") + width * F.col("bin")).alias("bin_start"), "n")
    )


def _fences(totals: DataFrame) -> DataFrame:
    reach = (F.col("q75") - F.col("q25")) * WHISKER
    return _quartiles(totals).withColumns(
        {"lower_fence": F.col("q25") - reach, "upper_fence": F.col("q75") + reach}
    )


def fences(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles and the bounds 1.5 interquartile ranges beyond them: one row per column."""
    return _fences(_totals(df, columns))


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, whiskers (outermost values inside the fences) and number of outliers."""
    totals = _totals(df, columns)
    inside = F.col("value").between(F.col("lower_fence"), F.col("upper_fence"))
    return (
        totals.join(F.broadcast(_fences(totals)), "column")
        .groupBy("column", "q25", "q50", "q75")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_outliers"),
        )
    )


def outlier_rows(df: DataFrame, column: str) -> DataFrame:
    """The rows whose value lies beyond the fences of the column."""
    bound = fences(df, [column]).select(F.struct("lower_fence", "upper_fence")).scalar()
    value: Column = F.col(column)
    return df.filter((value < bound["lower_fence"]) | (value > bound["upper_fence"]))
