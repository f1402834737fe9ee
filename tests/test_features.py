"""Lookup, contracts, rules, sources and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom import contracts
from marketloom.operators import events, features, retrieval, signals
from marketloom.session import work_path
from marketloom.sources import bars as bar_source
from marketloom.sources import tables as io
from marketloom.streaming import features as stream_features


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_asof_edges(spark):
    rows = [("A", ts("2024-01-01T10:00:00"), 1.0), ("A", ts("2024-01-01T12:00:00"), 2.0),
            ("B", ts("2024-01-05T00:00:00"), 9.0)]
    feats = spark.createDataFrame(rows, "ticker string, date timestamp_ntz, close double")
    asks = [("A", "2024-01-01T09:59:59", None), ("A", "2024-01-01T10:00:00", 1.0),
            ("A", "2024-01-01T11:59:59", 1.0), ("A", "2024-01-01T12:00:00", 2.0),
            ("A", "2024-01-02T12:00:00", 2.0), ("A", "2024-01-02T12:00:01", None),
            ("C", "2024-01-01T12:00:00", None), ("B", "2024-01-05T23:59:59", 9.0)]
    ents = spark.createDataFrame([(k, ts(t)) for k, t, _ in asks], "ticker string, event_timestamp timestamp_ntz")
    for size in (None, 60, 86_400, 500_000):
        got = features.asof_features(ents, feats, ["close"], bucket_seconds=size).collect()
        found = {(r["ticker"], r["event_timestamp"]): r["close"] for r in got}
        assert found == {(k, ts(t)): v for k, t, v in asks}


def test_asof_hot_ticker_plan(spark):
    feats = spark.createDataFrame([("A", ts("2024-01-01T10:00:00"), 1.0)], "ticker string, date timestamp_ntz, close double")
    # all requests are for one ticker and time, written so that the planner cannot see it
    ents = spark.range(1000).select(
        F.when(F.col("id") >= 0, "A").alias("ticker"),
        F.when(F.col("id") >= 0, F.lit("2024-01-01 11:00:00").cast("timestamp_ntz")).alias("event_timestamp"))
    out = features.asof_features(ents, feats, ["close"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert out.filter("close = 1.0").count() == 1000


def test_view_projection(spark):
    view = features.stock_view()
    assert view.describe(spark).count() == 25
    with pytest.raises(ValueError):
        view.project(spark.createDataFrame([("A", ts("2024-01-01"))], "ticker string, date timestamp_ntz"), ["nope"])


def test_insert_keeps_existing(spark):
    old = spark.createDataFrame([("a", "old")], "id string, text string")
    new = spark.createDataFrame([("a", "new", 0), ("b", "first", 1), ("b", "second", 2)], "id string, text string, position int")
    got = {(r["id"], r["text"]) for r in features.insert_if_absent(old, new).collect()}
    assert got == {("a", "old"), ("b", "first")}


def test_contracts(spark):
    rows = [("2024-01-01", "A", "1.5", "2", "1", "1.2", "100"), ("bad", None, "x", "2", "1", "1.2", None)]
    df = spark.createDataFrame(rows, "date string, ticker string, open string, high string, low string, close string, volume string")
    with pytest.raises(contracts.ContractError, match="open castable"):
        contracts.validate(df, contracts.RAW)
    good = contracts.validate(df.filter("ticker = 'A'"), contracts.RAW)
    assert dict(good.dtypes)["volume"] == "bigint" and dict(good.dtypes)["date"] == "timestamp_ntz"
    broken = contracts.quarantine(df, contracts.RAW).orderBy("ticker").collect()
    assert broken[0]["broken"] == ["date:castable", "ticker:not_null", "open:castable", "volume:not_null"]
    assert broken[1]["broken"] == []
    with pytest.raises(contracts.ContractError, match="missing columns"):
        contracts.validate(df.select("date", "ticker"), contracts.FEATURES)
    assert contracts.missing_columns(df, contracts.PREDICTION)[0] == "sma_5"


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert contracts.null_report(df).collect()[0]["missing"] == 2


def frame(spark, rows):
    return spark.createDataFrame(rows, "rsi double, price double, a double, b double")


def test_rules(spark):
    args = [F.col(c) for c in ("rsi", "price", "a", "b")]
    df = frame(spark, [(75.0, 35.0, 32.0, 30.0), (20.0, 25.0, 30.0, 32.0), (70.0, 31.0, 30.0, 32.0), (None, 1.0, 2.0, 1.0)])
    texts = [r[0] for r in df.select(signals.interpret(*args)).collect()]
    assert texts == ["overbought, bullish trend", "oversold, bearish trend", "neutral RSI, mixed trend", "neutral RSI, mixed trend"]
    points = [tuple(r[0]) for r in df.select(signals.rule_points(*args)).collect()]
    assert points == [(2, 2), (2, 2), (2, 0), (0, 2)]


def test_recommendation(spark):
    df = spark.createDataFrame([(1, 0.75), (0, 0.75), (1, 0.65), (0, 0.65), (1, 0.6), (0, 0.3)], "y int, p double")
    got = [r[0].split(" - ")[0] for r in df.select(signals.recommend(F.col("y"), F.col("p"))).collect()]
    assert got == ["COMPRA FORTE", "VENDA FORTE", "COMPRA", "VENDA", "NEUTRO", "NEUTRO"]


def test_compare_ties_keep_order(spark):
    rows = [(t, ts(f"2024-01-0{d}"), c) for t, cs in (("B", (10, 11)), ("A", (10, 11)), ("C", (10, 9))) for d, c in enumerate(cs, 1)]
    df = spark.createDataFrame([(t, d, float(c), float(c), float(c), float(c), 1) for t, d, c in rows],
                               "ticker string, date timestamp_ntz, open double, high double, low double, close double, volume long")
    got = signals.compare_stocks(df, "max", ["B", "A", "C", "MISSING"]).orderBy("rank").collect()
    assert [r["ticker"] for r in got] == ["B", "A", "C"]
    assert [r["is_best"] for r in got] == [True, False, False] and got[2]["is_worst"]
    with pytest.raises(ValueError):
        signals.period_filter(df, "7w")


def test_short_ticker_gets_error(spark):
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 1.0, 1.0, 1.0, 1.0, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "ticker string, date timestamp_ntz, open double, high double, low double, close double, volume long")
    row = signals.indicator_snapshot(df, "max").collect()[0]
    assert row["error"] == "Insufficient data for A" and row["sma_20"] is None


def test_topk_by_cells(spark):
    docs = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(50)], "id long, embedding array<double>")
    asks = spark.createDataFrame([(q, [q + 0.4, 0.0]) for q in range(20)], "query_id long, embedding array<double>")
    got = retrieval.vector_topk(docs, asks, k=2, pivots=5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(q, i) for q in range(20) for i in (q, q + 1)]
    plan = retrieval.vector_topk(docs, asks, k=2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_histogram_quantile(spark):
    df = spark.createDataFrame([("a", 0.02)] * 90 + [("a", 0.3)] * 10 + [("b", 99.0)], "k string, v double")
    counts = df.groupBy("k").agg(*events.bucket_counts(F.col("v"), events.LATENCY_BUCKETS))
    got = {r["k"]: r["q"] for r in counts.select("k", events.quantile_of_buckets(0.95, events.LATENCY_BUCKETS).alias("q")).collect()}
    assert got["a"] == pytest.approx(0.1 + 0.4 * 5 / 10) and got["b"] == 5.0


def test_flood_from_one_address(spark):
    always = F.col("id") >= 0
    df = spark.range(5000).select(
        "id", F.when(always, "x").alias("address"), F.when(always, "predict").alias("endpoint"),
        F.when(always, F.lit("2024-01-01 00:00:01").cast("timestamp_ntz")).alias("ts"))
    out = events.limited_requests(df, "address", "endpoint", ["ts", "id"])
    assert out.filter("NOT rejected").count() == 30 and out.filter("rejected").count() == 4970
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    many = events.limited_requests(df, "address", "endpoint", ["ts", "id"], limit=100_000)
    assert many.filter("rejected").count() == 0
    row = events.rate_limit(df, "address", "endpoint").collect()[0]
    assert (row["n"], row["accepted"], row["rejected"]) == (5000, 30, 4970)


def test_wide_to_long_missing_fields(spark):
    wide = spark.createDataFrame([("d1", 1.0, 2.0, 10), ("d2", None, 3.0, None)], "date string, `Close|A` double, `Close|B` double, `Volume|A` long")
    got = sorted((r["date"], r["ticker"], r["close"], r["volume"]) for r in bar_source.wide_to_long(wide).collect())
    assert got == [("d1", "A", 1.0, 10), ("d1", "B", 2.0, None), ("d2", "B", 3.0, None)]


def test_files(spark):
    path = work_path(spark, "t")
    assert not io.exists(spark, path)
    with pytest.raises(FileNotFoundError):
        io.load_golden(spark, path)
    with pytest.raises(ValueError):
        io.resolve("x", "ftp")
    assert io.resolve("/a/b", "s3", "bucket/") == "s3a://bucket/a/b"
    lines = spark.createDataFrame([('{"id": "1", "contexts": ["a"]}',), ("",), ('{"id": "2"}',)], "v string")
    io.write_text(lines.coalesce(1), path, "v")
    assert {r["id"] for r in io.load_golden(spark, path).collect()} == {"1", "2"}


def test_sorted_files(spark):
    path = work_path(spark, "sorted")
    rows = spark.range(1000).select((F.col("id") % 7).alias("ticker"), (F.col("id") * 37 % 1000).alias("date"))
    io.write_sorted(rows, path, ["ticker", "date"])
    seen = [(r["f"], r["ticker"], r["date"]) for r in
            spark.read.parquet(path).select(F.col("_metadata.file_name").alias("f"), "ticker", "date").collect()]
    keys = [k[1:] for k in sorted(seen, key=lambda k: k[0])]
    assert len(keys) == 1000 and keys == sorted(keys)


def test_stream_upsert_over_batches(spark):
    source, target, state = (work_path(spark, n) for n in ("src", "dst", "state"))
    schema = "ticker string, date timestamp_ntz, close double"
    for batch in ([("A", ts("2024-01-02"), 2.0), ("B", ts("2024-01-01"), 1.0)], [("A", ts("2024-01-01"), 0.0), ("B", ts("2024-01-03"), 3.0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = stream_features.start_materialize(stream, target, state)
        query.awaitTermination()
    got = stream_features.read_latest(spark, target, spark.read.parquet(source).schema, 2).collect()
    assert {(r["ticker"], r["close"]) for r in got} == {("A", 2.0), ("B", 3.0)}


def test_write_bytes_round_trip(spark, tmp_path):
    content = bytes(range(256)) * 3
    io.write_bytes(spark, content, f"{tmp_path}/x.bin")
    row = io.read_bytes(spark, f"{tmp_path}/x.bin").collect()[0]
    assert bytes(row["content"]) == content and row["length"] == len(content)


def test_late_key_is_refreshed(spark):
    schema = "ticker string, date timestamp_ntz, x double"
    day = lambda d: dt.datetime(2024, 1, d)
    old = spark.createDataFrame([("a", day(20), 1.0)], schema)
    new = spark.createDataFrame([("a", day(10), 2.0), ("a", day(21), 3.0), ("b", day(5), 4.0)], schema)
    got = {r["ticker"]: (r["date"].day, r["x"]) for r in features.materialize_incremental(old, new).collect()}
    assert got == {"a": (21, 3.0), "b": (5, 4.0)}


def test_equal_new_ids_without_position(spark):
    existing = spark.createDataFrame([("1", "old")], "id string, text string")
    new = spark.createDataFrame([("1", "x"), ("2", "b"), ("2", "a")], "id string, text string")
    got = sorted(tuple(r) for r in features.insert_if_absent(existing, new).collect())
    assert got == [("1", "old"), ("2", "a")]
