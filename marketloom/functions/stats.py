"""Test statistics as column expressions, and p-values of the few result rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

KS_TERMS = 100


def ks_pvalue(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sided Kolmogorov-Smirnov p-value, 2*sum((-1)^(k-1) * exp(-2 k^2 x^2))."""
    x2 = d * d * F.try_divide(n1 * n2, n1 + n2)
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        lambda k: F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(-2.0 * k.cast("double") * k.cast("double") * x2),
    )
    total = 2 * F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    # the series does not converge for tiny distances, where the p-value is 1
    return F.when(x2 < 0.02, F.lit(1.0)).otherwise(
        F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0))
    )


def _normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution by its finite sums for whole degrees."""
    half = x / 2
    if math.isinf(half):
        return 0.0
    if half <= 0:
        return 1.0
    if dof % 2 == 0:
        total, powers = 0.0, [float(i) for i in range(dof // 2)]
    else:
        total, powers = math.erfc(math.sqrt(half)), [i + 0.5 for i in range(dof // 2)]
    log_half = math.log(half)
    total += sum(math.exp(p * log_half - half - math.lgamma(p + 1)) for p in powers)
    return min(1.0, total)


@F.pandas_udf(DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value; used on result rows only."""
    return z.map(lambda v: None if pd.isna(v) else _normal_two_sided(v)).astype("float64")


@F.pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper chi-square p-value; used on result rows only."""
    return pd.Series(
        [None if pd.isna(v) or d < 1 else _chi2_tail(v, int(d)) for v, d in zip(x, dof)],
        dtype="float64",
    )
