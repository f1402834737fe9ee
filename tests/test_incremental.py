"""Incremental indicators against the whole history."""

import datetime
import random

import pytest

from marketloom.operators import incremental as inc
from marketloom.operators.indicators import INDICATOR_COLUMNS, add_indicators


def bar(ticker, day, price):
    date = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)
    return (ticker, date, price, price + 1, price - 1, price + (day % 3) / 7, 1000 + 37 * day % 91)


def history(ticker, n, seed=0):
    rng = random.Random(f"{ticker}{seed}")
    return [bar(ticker, day, 30 + rng.random() * 10) for day in range(n)]


def check(spark, folder, runs, whole):
    expected = add_indicators(spark.createDataFrame(whole, inc.BARS_SCHEMA))
    values = lambda df: {(r.ticker, r.date): [-1e99 if r[c] is None else r[c] for c in ["close", *INDICATOR_COLUMNS]] for r in df.collect()}
    got, expected = values(inc.read_indicators(spark, folder, runs)), values(expected)
    assert got.keys() == expected.keys()
    for key, row in expected.items():
        assert got[key] == pytest.approx(row, rel=1e-9, abs=1e-9, nan_ok=True), key


def run(spark, folder, *slices):
    for number, rows in enumerate(slices):
        inc.update_indicators(spark, folder, spark.createDataFrame(rows, inc.BARS_SCHEMA), number)


def test_appended_slices_and_new_tickers(spark, tmp_path):
    a, b, c = history("A", 130), history("B", 70), history("C", 3)
    run(spark, str(tmp_path), a[:60] + b[:10], a[60:61] + b[10:40], [], a[61:] + b[40:] + c)
    check(spark, str(tmp_path), 4, a + b + c)


def test_late_and_corrected_bars(spark, tmp_path):
    a, b = history("A", 120), history("B", 120)
    early = [x for x in a[:80] if x not in (a[50], a[20])]
    fixed = bar("B", 70, 99.0)
    late = [a[50]] + a[100:] + [fixed]
    run(spark, str(tmp_path), early[:40] + b[:40], early[40:] + b[40:100], a[80:100], late, [a[20]] + b[100:])
    whole = a + [fixed if x[1] == fixed[1] else x for x in b]
    check(spark, str(tmp_path), 5, whole)


def test_repeated_run_and_order_of_runs(spark, tmp_path):
    a = history("A", 90)
    run(spark, str(tmp_path), a[:50], a[50:60])
    inc.update_indicators(spark, str(tmp_path), spark.createDataFrame(a[50:], inc.BARS_SCHEMA), 1)
    check(spark, str(tmp_path), 2, a)
    with pytest.raises(ValueError):
        inc.update_indicators(spark, str(tmp_path), spark.createDataFrame(a, inc.BARS_SCHEMA), 5)


def test_no_old_bars_are_read_without_late_ones(spark, tmp_path):
    """Old bars may even be gone."""
    import shutil

    a = history("A", 90)
    run(spark, str(tmp_path), a[:60])
    shutil.rmtree(tmp_path / "bars" / "run=0")
    inc.update_indicators(spark, str(tmp_path), spark.createDataFrame(a[60:], inc.BARS_SCHEMA), 1)
    check(spark, str(tmp_path), 2, a)
