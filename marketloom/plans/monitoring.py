"""Request metrics in batch and on streams, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import events as ev
from marketloom.operators.drift import drift_table
from marketloom.plans.analysis import LINE_LONG, LINE_TABLE, LINE_TESTS, MEASURES, line_samples
from marketloom.plans.registry import query
from marketloom.plans.tables import HOURLY_SQL, daily_bars, hourly_bars, rounded, table
from marketloom.plans.tables import BARS_SQL
from marketloom.plans.text import JUDGED, replies
from marketloom.operators import evaluation as judge
from marketloom.session import stage, work_path
from marketloom.sources import tables as io
from marketloom.sources.digests import file_digests
from marketloom.sources.refresh import refresh_partitions
from marketloom.streaming import features as sfeat
from marketloom.streaming import limits as slim
from marketloom.streaming import metrics as smet


def log(spark, sf):
    """Events as a request log: endpoint, address, latency in seconds, tokens."""
    events = table(spark, sf, "events")
    return events.select(
        "event_id", "ts", F.col("event_type").alias("endpoint"), F.col("user_id").alias("address"),
        (F.col("value") / 100).alias("latency"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"),
    )


LOG = """
log AS (SELECT event_id, ts, event_type AS endpoint, user_id AS address, value / 100 AS latency,
  json_extract_string(props, '$.k')::BIGINT AS tokens FROM events)"""


LIMIT_SQL = "CASE endpoint " + " ".join(
    f"WHEN '{name}' THEN {limit}" for name, limit in ev.LIMITS_PER_MINUTE.items()
) + f" ELSE {ev.DEFAULT_LIMIT} END"


def latency():
    return F.col("latency")


def naive(df, columns=("window_start", "window_end")):
    """Window bounds without a time zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns if c in df.columns})


@query(
    "metric_counters",
    f"""WITH {LOG}, w AS (SELECT endpoint, count(*)::DOUBLE AS total, sum(tokens)::DOUBLE AS input_tokens,
      sum(address)::DOUBLE AS output_tokens FROM log GROUP BY endpoint)
    SELECT endpoint, metric, value FROM w UNPIVOT (value FOR metric IN (total, input_tokens, output_tokens))""",
)
def q_counters(spark, sf):
    amounts = {"input_tokens": F.col("tokens"), "output_tokens": F.col("address")}
    return ev.counters(log(spark, sf), ["endpoint"], amounts)


@query(
    "gauges",
    f"WITH {LOG} SELECT endpoint, arg_max(latency, ts) AS value FROM log GROUP BY endpoint",
)
def q_gauges(spark, sf):
    return ev.gauges(log(spark, sf), ["endpoint"], "latency", F.col("ts"))


def histogram_sql(bounds: list[float], value: str) -> str:
    cases = ", ".join(
        f"('{b:g}', {b}::DOUBLE)" for b in bounds
    )
    return f"""SELECT endpoint, le, count_if({value} <= bound)::BIGINT AS n, round(sum({value}), 4) AS sum,
      count(*)::BIGINT AS count FROM log, (VALUES {cases}, ('+Inf', 'infinity'::DOUBLE)) b(le, bound)
    GROUP BY endpoint, le"""


@query("latency_histogram", f"WITH {LOG} {histogram_sql(ev.LATENCY_BUCKETS, 'latency')}")
def q_histogram(spark, sf):
    return rounded(ev.cumulative_histogram(log(spark, sf), ["endpoint"], latency()))


@query(
    "confidence_histogram",
    f"WITH {LOG} {histogram_sql(ev.CONFIDENCE_BUCKETS, 'least(latency, 1)')}",
)
def q_confidence(spark, sf):
    value = F.least(latency(), F.lit(1.0))
    return rounded(ev.cumulative_histogram(log(spark, sf), ["endpoint"], value, ev.CONFIDENCE_BUCKETS))


RATE = """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start,
      time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end, endpoint,
      count(*)::BIGINT AS n, round(count(*) / 300, 6) AS rate FROM log GROUP BY 1, 2, 3"""


@query("request_rate", f"WITH {LOG} {RATE}")
def q_rate(spark, sf):
    return rounded(naive(ev.request_rate(log(spark, sf), ["endpoint"])), 6)


@query(
    "sliding_rate",
    f"""WITH {LOG}, starts AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 1 MINUTE * k AS window_start,
      endpoint FROM log, range(0, 5) r(k))
    SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, endpoint, count(*)::BIGINT AS n,
      round(count(*) / 300, 6) AS rate FROM starts GROUP BY 1, 2, 3""",
)
def q_sliding(spark, sf):
    return rounded(naive(ev.sliding_rate(log(spark, sf), ["endpoint"])), 6)


def p95_sql(columns: str, group: str) -> str:
    bounds = ev.LATENCY_BUCKETS
    counts = ", ".join(f"count_if(latency <= {b})::DOUBLE AS c{i}" for i, b in enumerate(bounds))
    cases = " ".join(
        f"WHEN c{i} >= 0.95::DOUBLE * n THEN {bounds[i - 1] if i else 0}::DOUBLE + ({b}::DOUBLE - "
        f"{bounds[i - 1] if i else 0}::DOUBLE) * (0.95::DOUBLE * n - {f'c{i - 1}' if i else 0})"
        f" / (c{i} - {f'c{i - 1}' if i else 0})"
        for i, b in enumerate(bounds)
    )
    return f"""p AS (SELECT {columns}, count(*) AS n, {counts} FROM log GROUP BY {group}),
    q AS (SELECT *, CASE {cases} ELSE 5.0 END AS p95 FROM p)"""


HOUR5 = "time_bucket(INTERVAL 60 MINUTE, ts) AS window_start, time_bucket(INTERVAL 60 MINUTE, ts) + INTERVAL 60 MINUTE AS window_end, endpoint"


@query(
    "latency_p95",
    f"""WITH {LOG}, {p95_sql(HOUR5, '1, 2, 3')} SELECT window_start, window_end, endpoint, n::BIGINT AS n,
    round(p95, 6) AS quantile FROM q""",
)
def q_p95(spark, sf):
    out = ev.latency_percentile(log(spark, sf), ["endpoint"], latency(), minutes=60)
    return rounded(naive(out), 6)


@query(
    "rate_limit",
    f"""WITH {LOG}, c AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start,
      time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS window_end, endpoint, address, count(*) AS n
      FROM log GROUP BY 1, 2, 3, 4)
    SELECT window_start, window_end, address, endpoint, n::BIGINT AS n, least(n, l)::BIGINT AS accepted,
      greatest(n - l, 0)::BIGINT AS rejected FROM (SELECT *, {LIMIT_SQL} AS l FROM c)""",
)
def q_limit(spark, sf):
    return naive(ev.rate_limit(log(spark, sf), "address", "endpoint"))


@query(
    "rate_limit_shared",
    f"""WITH {LOG}, c AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start,
      time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS window_end, endpoint, address % 10 AS address, count(*) AS n
      FROM log GROUP BY 1, 2, 3, 4)
    SELECT window_start, window_end, address, endpoint, n::BIGINT AS n, least(n, 1)::BIGINT AS accepted,
      greatest(n - 1, 0)::BIGINT AS rejected FROM c""",
)
def q_limit_shared(spark, sf):
    """Addresses that many users share, and one request per minute, so that some are rejected."""
    rows = log(spark, sf).withColumn("address", F.col("address") % 10)
    return naive(ev.rate_limit(rows, "address", "endpoint", limit=F.lit(1)))


@query(
    "limited_requests",
    f"""WITH {LOG} SELECT event_id, row_number() OVER (PARTITION BY address, endpoint, date_trunc('minute', ts)
      ORDER BY ts, event_id) > {LIMIT_SQL} AS rejected FROM log""",
)
def q_limited(spark, sf):
    out = ev.limited_requests(log(spark, sf), "address", "endpoint", ["ts", "event_id"])
    return out.select("event_id", "rejected")


@query(
    "limited_requests_shared",
    f"""WITH {LOG} SELECT event_id, row_number() OVER (PARTITION BY address % 10, endpoint, date_trunc('minute', ts)
      ORDER BY ts, event_id) > 1 AS rejected FROM log""",
)
def q_limited_shared(spark, sf):
    rows = log(spark, sf).withColumn("address", F.col("address") % 10)
    out = ev.limited_requests(rows, "address", "endpoint", ["ts", "event_id"], limit=1)
    return out.select("event_id", "rejected")


@query(
    "alerts",
    f"""WITH {LOG}, {p95_sql("time_bucket(INTERVAL 60 MINUTE, ts) AS window_start", '1')},
    e AS (SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS window_start, avg((endpoint = 'error')::INT) AS error_rate,
      count_if(tokens > 50)::DOUBLE AS pii FROM log GROUP BY 1)
    SELECT window_start, 'error_rate' AS alert, 'critical' AS severity, round(error_rate, 6) AS value FROM e WHERE error_rate > 0.05::DOUBLE
    UNION ALL SELECT window_start, 'latency_p95', 'warning', round(p95, 6) FROM q WHERE p95 > 1
    UNION ALL SELECT window_start, 'pii_detections', 'warning', pii FROM e WHERE pii > 10""",
)
def q_alerts(spark, sf):
    out = ev.alerts(
        log(spark, sf), latency(), F.col("endpoint") == "error", F.col("tokens") > 50
    )
    return rounded(naive(out), 6)


@query(
    "drift_alerts",
    f"""WITH {LINE_LONG}, {MEASURES}, {LINE_TABLE} SELECT col AS feature, CASE WHEN score > 0.3 THEN 'critical' ELSE 'warning' END AS severity,
    round(score, 6) AS score FROM flags WHERE score > 0.15""",
)
def q_drift_alerts(spark, sf):
    return rounded(ev.drift_alerts(drift_table(*line_samples(spark, sf), tests=LINE_TESTS)), 6)


@query(
    "prediction_metrics",
    f"""WITH {LOG}, base AS (SELECT 'm' || (address % 3) AS model, 'v' || (tokens % 2) AS version,
      CASE WHEN endpoint = 'error' THEN 'timeout' END AS error, latency, least(latency, 1) AS confidence FROM log)
    SELECT 'predictions_total' AS metric, model || '/' || version AS label, NULL::VARCHAR AS le, count(*)::DOUBLE AS value FROM base GROUP BY 2
    UNION ALL SELECT 'prediction_errors_total', model || '/' || error, NULL, count(*)::DOUBLE FROM base WHERE error IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'latency_sum', '', NULL, round(sum(latency), 4) FROM base
    UNION ALL SELECT 'confidence_sum', '', NULL, round(sum(confidence), 4) FROM base
    UNION ALL SELECT 'latency_bucket', '', le, count_if(latency <= b)::DOUBLE FROM base,
      (VALUES {', '.join(f"('{b:g}', {b}::DOUBLE)" for b in ev.LATENCY_BUCKETS)}, ('+Inf', 'infinity'::DOUBLE)) t(le, b) GROUP BY le
    UNION ALL SELECT 'confidence_bucket', '', le, count_if(confidence <= b)::DOUBLE FROM base,
      (VALUES {', '.join(f"('{b:g}', {b}::DOUBLE)" for b in ev.CONFIDENCE_BUCKETS)}, ('+Inf', 'infinity'::DOUBLE)) t(le, b) GROUP BY le""",
)
def q_predictions(spark, sf):
    rows = log(spark, sf).select(
        F.concat(F.lit("m"), F.col("address") % 3).alias("model"),
        F.concat(F.lit("v"), F.col("tokens") % 2).alias("version"),
        F.when(F.col("endpoint") == "error", "timeout").alias("error"), "latency",
    )
    out = ev.prediction_metrics(
        rows, "model", "version", latency(), F.least(latency(), F.lit(1.0)), "error"
    )
    return rounded(out)


# --- streams -----------------------------------------------------------------------------------
def log_stream(spark, sf):
    """The same log read as a stream of files."""
    schema = table(spark, sf, "events").schema
    events = smet.read_stream(spark, sf, schema, "events*.parquet")
    return events.select(
        "event_id", "ts", F.col("event_type").alias("endpoint"), F.col("user_id").alias("address"),
        (F.col("value") / 100).alias("latency"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"),
    )


CLOSED = "window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@query("request_rate_stream", f"WITH {LOG}, r AS ({RATE}) SELECT * FROM r WHERE {CLOSED}")
def q_rate_stream(spark, sf):
    """Windows that the watermark has closed."""
    out = smet.run_windows(
        log_stream(spark, sf), lambda s: ev.request_rate(s, ["endpoint"]), "request-rate"
    )
    return rounded(naive(out), 6)


@query(
    "latency_p95_stream",
    f"""WITH {LOG}, {p95_sql(HOUR5, '1, 2, 3')} SELECT window_start, window_end, endpoint, n::BIGINT AS n,
    round(p95, 6) AS quantile FROM q WHERE {CLOSED}""",
)
def q_p95_stream(spark, sf):
    out = smet.run_windows(
        log_stream(spark, sf),
        lambda s: ev.latency_percentile(s, ["endpoint"], latency(), minutes=60),
        "latency-p95",
    )
    return rounded(naive(out), 6)


@query(
    "rate_limit_stream",
    f"""WITH {LOG}, c AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start,
      time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS window_end, address, endpoint, count(*) AS n
      FROM log GROUP BY 1, 2, 3, 4)
    SELECT window_start, window_end, address, endpoint, n::BIGINT AS n, least(n, 60)::BIGINT AS accepted,
      greatest(n - 60, 0)::BIGINT AS rejected FROM c WHERE {CLOSED}""",
)
def q_limit_stream(spark, sf):
    out = smet.run_windows(
        log_stream(spark, sf), lambda s: ev.rate_limit(s, "address", "endpoint"), "rate-limit"
    )
    return naive(out)


@query(
    "limited_requests_stream",
    f"""WITH {LOG}, r AS (SELECT event_id AS request_id, date_trunc('minute', ts)::TIMESTAMP AS minute,
      row_number() OVER (PARTITION BY address % 10, endpoint, date_trunc('minute', ts) ORDER BY ts, event_id) > 1 AS rejected
      FROM log)
    SELECT * FROM r WHERE minute + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def q_limited_stream(spark, sf):
    """Requests of the minutes that the watermark has closed; one per minute and shared address."""
    stream = log_stream(spark, sf).withColumn("address", F.col("address") % 10)
    out, state = work_path(spark, "limited"), work_path(spark, "limited-state")
    limited = slim.limited_stream(stream, "address", "endpoint", "event_id", limit=F.lit(1))
    started = limited.writeStream.outputMode("append").format("parquet").option("path", out).option(
        "checkpointLocation", state
    ).trigger(availableNow=True).start()
    started.awaitTermination()
    closed = table(spark, sf, "events").agg((F.max("ts") - F.expr("INTERVAL 11 MINUTES")).alias("until"))
    rows = naive(spark.read.schema(slim.OUTPUT).parquet(out), ["minute"])
    return rows.join(closed, F.col("minute") <= F.col("until")).drop("until")


@query(
    "alerts_stream",
    f"""WITH {LOG}, {p95_sql("time_bucket(INTERVAL 60 MINUTE, ts) AS window_start", '1')},
    e AS (SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS window_start, avg((endpoint = 'error')::INT) AS error_rate,
      count_if(tokens > 50)::DOUBLE AS pii FROM log GROUP BY 1),
    a AS (SELECT window_start, 'error_rate' AS alert, 'critical' AS severity, round(error_rate, 6) AS value FROM e WHERE error_rate > 0.05::DOUBLE
    UNION ALL SELECT window_start, 'latency_p95', 'warning', round(p95, 6) FROM q WHERE p95 > 1
    UNION ALL SELECT window_start, 'pii_detections', 'warning', pii FROM e WHERE pii > 10)
    SELECT * FROM a WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def q_alerts_stream(spark, sf):
    out = smet.run_windows(
        log_stream(spark, sf),
        lambda s: ev.alerts(s, latency(), F.col("endpoint") == "error", F.col("tokens") > 50),
        "alerts",
    )
    return rounded(naive(out), 6)


@query(
    "materialize_stream",
    """SELECT event_type AS ticker, ts AS date, value AS close FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) = 1""",
)
def q_materialize_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = smet.read_stream(spark, sf, schema, "events*.parquet").select(
        F.col("event_type").alias("ticker"), F.col("ts").alias("date"), F.col("value").alias("close")
    )
    target, state = work_path(spark, "latest"), work_path(spark, "latest-state")
    started = sfeat.start_materialize(stream, target, state)
    started.awaitTermination()
    return sfeat.read_latest(spark, target, stream.schema)


# --- sources and sinks -------------------------------------------------------------------------
@query("scan_parquet", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
def q_scan(spark, sf):
    lines = io.read_parquet(spark, f"{sf}/lineitem.parquet")
    recent = lines.filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return recent.select("l_orderkey", "l_extendedprice")


@query("parquet_partitioned", f"WITH {BARS_SQL} SELECT * FROM bars")
def q_partitioned(spark, sf):
    path = work_path(spark, "by-ticker")
    bars = daily_bars(spark, sf)
    io.write_parquet(bars, path, ["ticker"])
    return io.read_parquet(spark, path).select(bars.columns)


@query("parquet_sorted", f"WITH {BARS_SQL} SELECT * FROM bars")
def q_sorted(spark, sf):
    """Stored in the order of ticker and date."""
    path = work_path(spark, "sorted")
    bars = daily_bars(spark, sf)
    io.write_sorted(bars, path, ["ticker", "date"])
    return io.read_parquet(spark, path).select(bars.columns)


@query("csv_round_trip", f"WITH {BARS_SQL} SELECT * FROM bars")
def q_csv(spark, sf):
    path = work_path(spark, "csv")
    bars = daily_bars(spark, sf)
    io.write_csv(bars, path)
    return io.read_csv(spark, path, bars.schema)


@query("json_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def q_json(spark, sf):
    path = work_path(spark, "json")
    turns = table(spark, sf, "conversations")
    io.write_json(turns, path)
    return io.read_json(spark, path, turns.schema)


@query(
    "text_round_trip",
    "SELECT replace(text, chr(10), ' ') AS line, count(*)::BIGINT AS n FROM documents GROUP BY 1",
)
def q_text(spark, sf):
    path = work_path(spark, "text")
    lines = table(spark, sf, "documents").select(F.regexp_replace("text", "\n", " ").alias("line"))
    io.write_text(lines, path, "line")
    back = io.read_text(spark, path, whole=False)
    return back.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("file_listing")
def q_listing(spark, sf):
    files = io.list_files(spark, sf, "*.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("binary_scan")
def q_binary(spark, sf):
    files = file_digests(spark, f"{sf}/*.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256")


@query("ingest", f"WITH {HOURLY_SQL} SELECT * FROM hourly")
def q_ingest(spark, sf):
    """Build and store, then take the stored table without building again."""
    path = work_path(spark, "ingest")
    io.ingest(spark, lambda: hourly_bars(spark, sf), path)

    def fail():
        raise AssertionError("the stored table must be used")

    return io.ingest(spark, fail, path)


@query(
    "golden_load",
    """SELECT 'gs-' || item_id AS id, 'q' || item_id AS query, text AS expected_answer, 2::BIGINT AS n_contexts FROM benchmark""",
)
def q_golden_load(spark, sf):
    path = work_path(spark, "golden")
    items = table(spark, sf, "benchmark").select(
        F.concat(F.lit("gs-"), "item_id").alias("id"), F.concat(F.lit("q"), "item_id").alias("query"),
        F.lit("PETR4.SA").alias("ticker"), F.col("text").alias("expected_answer"),
        F.array(F.lit("a"), F.lit("b")).alias("contexts"),
    )
    io.write_json(items, path)
    return io.load_golden(spark, path).select(
        "id", "query", "expected_answer", F.size("contexts").cast("long").alias("n_contexts")
    )


@query(
    "drift_sink",
    f"""WITH {LINE_LONG}, {MEASURES}, {LINE_TABLE} SELECT col AS "column", test, round(score, 6) AS score, drifted FROM flags""",
)
def q_drift_sink(spark, sf):
    path = work_path(spark, "drift")
    out = drift_table(*line_samples(spark, sf), tests=LINE_TESTS)
    io.write_json(out, path)
    return rounded(io.read_json(spark, path, out.schema), 6)


@query(
    "benchmark_sink",
    f"WITH {JUDGED} SELECT variant_id, count(*)::BIGINT AS n, count_if(verdict = 'PASS')::BIGINT AS passed FROM results GROUP BY 1",
)
def q_benchmark_sink(spark, sf):
    path = work_path(spark, "benchmark")
    judged = stage(judge.judge_parse(replies(spark, sf)), "judged")
    rows = judged.select(
        "variant_id", F.col("doc_id").alias("entry_id"),
        F.struct("overall_score", "verdict", "error", "criteria").alias("judge"),
    )
    io.write_benchmark(rows, judge.judge_summary(judged, ["variant_id"]), path)
    back = io.read_json(spark, f"{path}/entries", rows.schema)
    return back.groupBy("variant_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("judge.verdict") == "PASS").alias("passed")
    )


@query("partition_refresh", f"WITH {BARS_SQL} SELECT *, year(date)::BIGINT AS year FROM bars")
def q_refresh(spark, sf):
    """Bars by year: stored with a wrong volume in one year, then refreshed from the right ones."""
    path = work_path(spark, "by-year")
    bars = stage(daily_bars(spark, sf).withColumn("year", F.year("date").cast("long")), "bars")
    wrong = F.when(F.col("year") == 1995, F.col("volume") + 1).otherwise(F.col("volume"))
    refresh_partitions(bars.withColumn("volume", wrong), path, ["year"])
    refresh_partitions(bars, path, ["year"])
    return io.read_parquet(spark, path).withColumn("year", F.col("year").cast("long")).select(bars.columns)
