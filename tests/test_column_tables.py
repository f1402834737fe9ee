"""Tables of one row per column are broadcast, so that the rows of a column never meet in one task."""

import pytest

from marketloom.operators import drift, profiles, timeseries


@pytest.fixture
def unsized(spark):
    """The planner broadcasts only what the code asks it to, as where sizes are not known."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "Join" in line]
    return [line for line in lines if "BroadcastHashJoin" in line and "[column#" in line], [
        line for line in lines if "SortMergeJoin [column#" in line and "_part" not in line
    ]


def rows(spark):
    old = spark.range(0, 400).selectExpr("cast(id AS double) AS x", "cast(id % 7 AS double) AS y")
    return old, spark.range(100, 500).selectExpr("cast(id AS double) AS x", "cast(id % 5 AS double) AS y")


def test_drift_rows_do_not_meet_by_column(unsized):
    for out in (
        drift.drift_wasserstein(*rows(unsized), ["x", "y"]), drift.drift_psi(*rows(unsized), ["x", "y"]),
        drift.drift_js(*rows(unsized), ["x", "y"]),
    ):
        broadcast, sorted_ = joins(out)
        assert broadcast and not sorted_
    got = {r["column"]: r["w1"] for r in drift.drift_wasserstein(*rows(unsized), ["x", "y"]).collect()}
    assert got["x"] == pytest.approx(100.0)
    described = unsized.createDataFrame([("x", [199.0])], "column string, quantiles array<double>")
    checked = profiles.rank_errors(rows(unsized)[0], ["x"], described, [0.5])
    assert not joins(checked)[1] and checked.collect()[0]["error"] <= 0.0025


def test_histogram_rows_do_not_meet_by_column(unsized):
    old, _ = rows(unsized)
    for out in (
        timeseries.histogram(old, ["x", "y"], 4), timeseries.describe(old, ["x", "y"]),
        timeseries.iqr_outliers(old, ["x", "y"]),
    ):
        assert joins(out)[0]
    plan = timeseries.histogram(old, ["x"])
    assert not joins(plan)[1]
    bins = sorted((r["column"], r["bin"], r["n"]) for r in timeseries.histogram(old, ["x"], 4).collect())
    assert bins == [("x", i, 100) for i in range(4)]
