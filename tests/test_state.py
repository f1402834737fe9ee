"""State in buckets with manifests, and profiles that merge."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import drift, profiles
from marketloom.streaming import features as sf

SCHEMA = "ticker string, date timestamp_ntz, close double"


def batch(spark, rows):
    frame = spark.createDataFrame([(k, f"2024-01-{d:02}", float(v)) for k, d, v in rows], "ticker string, d string, close double")
    return frame.select("ticker", F.col("d").cast("timestamp_ntz").alias("date"), "close")


def files(folder):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")
    }


def state(spark, target, **options):
    schema = spark.createDataFrame([], SCHEMA).schema
    return sorted((r.ticker, r.date.day, r.close) for r in sf.read_latest(spark, target, schema, **options).collect())


def test_only_touched_buckets_are_written(spark, tmp_path):
    target = str(tmp_path)
    first = [(f"k{i}", 1, i) for i in range(200)]
    sf.upsert_batch(batch(spark, first), 0, target, buckets=16)
    before = files(tmp_path / "data")
    sf.upsert_batch(batch(spark, [("k3", 2, 9), ("k3", 1, 7), ("k5", 1, 5)]), 1, target, buckets=16)
    assert {f: t for f, t in files(tmp_path / "data").items() if "batch=0" in f} == before
    touched = {f.split("bucket=")[1].split("/")[0] for f in files(tmp_path / "data") if "batch=1" in f}
    assert len(touched) <= 2
    expected = sorted((k, 2, 9.0) if k == "k3" else (k, d, float(v)) for k, d, v in first)
    assert state(spark, target) == expected
    assert state(spark, target, keys=["k3", "k77", "none"], buckets=16) == [x for x in expected if x[0] in ("k3", "k77")]

    again = files(tmp_path)
    sf.upsert_batch(batch(spark, [("k3", 3, 1)]), 1, target, buckets=16)  # a batch that is done
    assert files(tmp_path) == again and state(spark, target) == expected
    sf.upsert_batch(batch(spark, []), 2, target, buckets=16)
    assert state(spark, target) == expected
    sf.expire(spark, target)
    assert len(files(tmp_path / "data")) < len(again) and state(spark, target) == expected


def test_batch_without_manifest_is_repeated(spark, tmp_path):
    target = str(tmp_path)
    sf.upsert_batch(batch(spark, [("a", 1, 1)]), 0, target)
    sf.upsert_batch(batch(spark, [("a", 5, 5), ("b", 1, 1)]), 1, target)
    os.remove(tmp_path / "manifest" / "batch=1" / "_SUCCESS")  # as if the job had ended here
    assert state(spark, target) == [("a", 1, 1.0)]
    sf.upsert_batch(batch(spark, [("a", 5, 5), ("b", 1, 1)]), 1, target)
    assert state(spark, target) == [("a", 5, 5.0), ("b", 1, 1.0)]


@pytest.fixture(scope="module")
def days(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({
        "day": np.repeat(np.arange(30), 700), "x": rng.normal(size=21000), "y": rng.exponential(size=21000),
        "z": rng.integers(0, 4, 21000),
    })
    frame.loc[::50, "x"] = np.nan
    return spark.createDataFrame(frame).withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def test_merged_days_describe_all_rows(days):
    probs = [0.01, 0.1, 0.25, 0.5, 0.9, 0.999]
    stored = profiles.profile(days, ["x", "y", "z"], "day")
    assert stored.count() == 90
    described = profiles.describe_profiles(stored, probs)
    frame = days.toPandas()
    for r in described.collect():
        column = frame[r.column].dropna()
        assert (r["count"], r["min"], r["max"]) == (len(column), column.min(), column.max())
        assert r["mean"] == pytest.approx(column.mean()) and r["std"] == pytest.approx(column.std())
    errors = profiles.rank_errors(days, ["x", "y", "z"], described, probs).collect()
    assert len(errors) == 18 and max(e.error for e in errors) <= profiles.RANK_ERROR


def test_drift_from_profiles(days):
    old, new = days.filter("day < 20"), days.filter("day >= 20").withColumn("x", F.col("x") + 0.6)
    got = {r.column: r for r in profiles.profile_drift(
        profiles.profile(old, ["x", "y"], "day"), profiles.profile(new, ["x", "y"])).collect()}
    a, b = (f.toPandas() for f in (old, new))
    for c in ("x", "y"):
        u, v = np.sort(a[c].dropna()), np.sort(b[c].dropna())
        at = np.concatenate([u, v])
        d = np.abs(np.searchsorted(u, at, side="right") / len(u) - np.searchsorted(v, at, side="right") / len(v)).max()
        assert got[c].ks == pytest.approx(d, abs=2 * (profiles.RANK_ERROR + 1 / profiles.GRID))
        edges = np.quantile(u, np.arange(1, 10) / 10)
        p, q = (np.maximum(np.bincount(np.searchsorted(edges, s), minlength=10) / len(s), drift.SHARE_FLOOR) for s in (u, v))
        assert got[c].psi == pytest.approx(((q - p) * np.log(q / p)).sum(), rel=0.1, abs=0.01)


def test_profiles_of_nothing(spark, days):
    none = profiles.profile(days.limit(0), ["x", "y"], "day")
    assert none.collect() == [] and profiles.describe_profiles(none).collect() == []
    assert profiles.profile_drift(none, profiles.profile(days, ["x"])).collect() == []
