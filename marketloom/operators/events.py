"""Request metrics: counters, gauges, histograms, rates, percentiles, limits, alerts.

Every function works on a batch; those that group by ``window`` also run on a stream with a
watermark (see ``marketloom.streaming``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bucket bounds, limits per minute, and alert conditions.
LATENCY_BUCKETS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0]
CONFIDENCE_BUCKETS = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]
DEFAULT_LIMIT = 60
LIMITS_PER_MINUTE = {"predict": 30, "agent": 10}
ERROR_RATE_LIMIT = 0.05
LATENCY_LIMIT = 1.0
PII_PER_HOUR = 10
DRIFT_WARNING, DRIFT_CRITICAL = 0.15, 0.30
INFINITY = "+Inf"


def counters(
    df: DataFrame, labels: list[str], amounts: dict[str, Column] | None = None
) -> DataFrame:
    """(labels, metric, value): number of rows as ``total``, and the sum of each amount."""
    sums = {"total": F.count(F.lit(1))} | {n: F.sum(c) for n, c in (amounts or {}).items()}
    wide = df.groupBy(*labels).agg(*[v.cast("double").alias(n) for n, v in sums.items()])
    rows = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in sums]
    return wide.select(*labels, F.inline(F.array(*rows)))


def gauges(df: DataFrame, labels: list[str], value: str, order: Column) -> DataFrame:
    """Last value per label set; ``order`` must not have ties inside one."""
    return df.groupBy(*labels).agg(F.max_by(value, order).alias("value"))


def bucket_counts(value: Column, bounds: list[float]) -> list[Column]:
    """Aggregates ``le_0``, ``le_1``...: values up to each bound, and all of them."""
    inside = [F.count_if(value <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return [*inside, F.count(value).alias(f"le_{len(bounds)}")]


def cumulative_histogram(
    df: DataFrame, labels: list[str], value: Column, bounds: list[float] = LATENCY_BUCKETS
) -> DataFrame:
    """(labels, le, n, sum, count): cumulative counts per bound, the last one ``+Inf``."""
    wide = df.groupBy(*labels).agg(
        *bucket_counts(value, bounds), F.sum(value).alias("sum"), F.count(value).alias("count")
    )
    names = [f"{b:g}" for b in bounds] + [INFINITY]
    rows = [F.struct(F.lit(n).alias("le"), F.col(f"le_{i}").alias("n")) for i, n in enumerate(names)]
    return wide.select(*labels, F.inline(F.array(*rows)), "sum", "count")


def quantile_of_buckets(q: float, bounds: list[float]) -> Column:
    """Quantile from the ``le_i`` columns: linear inside the bucket that holds the rank.

    Ranks beyond the last bound give that bound; the first bucket starts at 0.
    """
    top = len(bounds)
    rank = F.lit(q) * F.col(f"le_{top}")
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(top)):
        low = F.lit(float(bounds[i - 1]) if i else 0.0)
        below = F.col(f"le_{i - 1}") if i else F.lit(0)
        share = F.try_divide(rank - below, F.col(f"le_{i}") - below)
        inside = low + (F.lit(float(bounds[i])) - low) * share
        out = F.when(F.col(f"le_{i}") >= rank, inside).otherwise(out)
    return F.when(F.col(f"le_{top}") > 0, out)


def _window(ts: str, length: str, slide: str | None = None) -> Column:
    return F.window(F.col(ts), length, slide) if slide else F.window(F.col(ts), length)


def _unpacked(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest
    )


def request_rate(df: DataFrame, labels: list[str], ts: str = "ts", minutes: int = 5) -> DataFrame:
    """Requests per second in tumbling windows."""
    counts = df.groupBy(_window(ts, f"{minutes} minutes"), *labels).agg(F.count(F.lit(1)).alias("n"))
    return _unpacked(counts.withColumn("rate", F.col("n") / (minutes * 60)))


def sliding_rate(
    df: DataFrame, labels: list[str], ts: str = "ts", minutes: int = 5, slide: int = 1
) -> DataFrame:
    """Requests per second in windows that start every ``slide`` minutes.

    Rows are counted per slide first; only these counts are copied into the windows they belong to.
    """
    small = df.groupBy(_window(ts, f"{slide} minutes"), *labels).agg(F.count(F.lit(1)).alias("_n"))
    rest = small.select(F.col("window.start").alias("_ts"), *labels, "_n")
    wide = rest.groupBy(_window("_ts", f"{minutes} minutes", f"{slide} minutes"), *labels).agg(
        F.sum("_n").alias("n")
    )
    return _unpacked(wide.withColumn("rate", F.col("n") / (minutes * 60)))


def latency_percentile(
    df: DataFrame, labels: list[str], value: Column, q: float = 0.95, ts: str = "ts",
    minutes: int = 5, bounds: list[float] = LATENCY_BUCKETS,
) -> DataFrame:
    """Percentile per window from the histogram buckets, as a monitoring server computes it."""
    counts = df.groupBy(_window(ts, f"{minutes} minutes"), *labels).agg(*bucket_counts(value, bounds))
    out = counts.withColumns(
        {"n": F.col(f"le_{len(bounds)}"), "quantile": quantile_of_buckets(q, bounds)}
    )
    return _unpacked(out.drop(*[f"le_{i}" for i in range(len(bounds) + 1)]))


def limit_of(endpoint: Column) -> Column:
    """Requests per minute that an endpoint allows one address."""
    limits = F.create_map(*[F.lit(x) for pair in LIMITS_PER_MINUTE.items() for x in pair])
    return F.coalesce(F.try_element_at(limits, endpoint), F.lit(DEFAULT_LIMIT))


def rate_limit(
    df: DataFrame, address: str, endpoint: str, ts: str = "ts", limit: Column | None = None
) -> DataFrame:
    """Accepted and rejected requests per (address, endpoint, minute)."""
    counts = df.groupBy(_window(ts, "1 minute"), address, endpoint).agg(F.count(F.lit(1)).alias("n"))
    allowed = limit_of(F.col(endpoint)) if limit is None else limit
    out = counts.withColumns(
        {
            "accepted": F.least(F.col("n"), allowed.cast("long")),
            "rejected": F.greatest(F.col("n") - allowed, F.lit(0)).cast("long"),
        }
    )
    return _unpacked(out)


def limited_requests(
    df: DataFrame, address: str, endpoint: str, order: list[str], ts: str = "ts",
    limit: int | None = None,
) -> DataFrame:
    """Add ``rejected`` to each request: all but the first ``limit`` of its minute.

    Only the last accepted request of a full minute is searched for. The ranking keeps at most as
    many rows per group as the highest limit allows, in every task before the shuffle, so a flood
    from one address is cut down where it is read.
    """
    allowed = limit_of(F.col(endpoint)) if limit is None else F.lit(limit)
    highest = max(DEFAULT_LIMIT, *LIMITS_PER_MINUTE.values()) if limit is None else limit
    rows = df.withColumn("_minute", F.date_trunc("minute", ts))
    keys = [address, endpoint, "_minute"]
    ranked = rows.select(*keys, F.struct(*order).alias("_order")).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_order"))
    )
    cuts = ranked.filter(F.col("_rank") <= highest).filter(F.col("_rank") == allowed)
    cuts = cuts.select(*keys, F.col("_order").alias("_last"))
    joined = rows.join(cuts, keys, "left")
    late = F.coalesce(F.struct(*order) > F.col("_last"), F.lit(False))
    return joined.withColumn("rejected", late).drop("_minute", "_last")


def alerts(
    df: DataFrame, latency: Column, is_error: Column, has_pii: Column, ts: str = "ts"
) -> DataFrame:
    """(window_start, alert, severity, value) per hour: error rate, latency P95, personal data."""
    hourly = df.groupBy(_window(ts, "1 hour")).agg(
        F.avg(is_error.cast("double")).alias("error_rate"),
        *bucket_counts(latency, LATENCY_BUCKETS),
        F.count_if(has_pii).cast("double").alias("pii"),
    )
    p95 = quantile_of_buckets(0.95, LATENCY_BUCKETS)
    checks = [
        ("error_rate", "critical", F.col("error_rate"), ERROR_RATE_LIMIT),
        ("latency_p95", "warning", p95, LATENCY_LIMIT),
        ("pii_detections", "warning", F.col("pii"), float(PII_PER_HOUR)),
    ]
    rows = [
        F.when(value > limit, F.struct(
            F.lit(name).alias("alert"), F.lit(severity).alias("severity"), value.alias("value")))
        for name, severity, value, limit in checks
    ]
    return hourly.select(
        F.col("window.start").alias("window_start"), F.inline(F.array_compact(F.array(*rows)))
    )


def drift_alerts(scores: DataFrame, feature: str = "column", score: str = "score") -> DataFrame:
    """Drift scores above the warning or the critical level."""
    value = F.col(score)
    severity = F.when(value > DRIFT_CRITICAL, "critical").when(value > DRIFT_WARNING, "warning")
    return scores.select(F.col(feature).alias("feature"), severity.alias("severity"), score).filter(
        "severity IS NOT NULL"
    )


def prediction_metrics(
    df: DataFrame, model: str, version: str, latency: Column, confidence: Column, error: str
) -> DataFrame:
    """All metrics of a prediction log in one pass: (metric, label, le, value).

    Predictions and errors per model, and the two histograms with their sums.
    """
    base = df.select(
        F.col(model).alias("model"), F.col(version).alias("version"), F.col(error).alias("error"),
        latency.alias("latency"), confidence.alias("confidence"),
    )
    bounds = {"latency": LATENCY_BUCKETS, "confidence": CONFIDENCE_BUCKETS}
    # partial sums per label set keep everything additive; the final sums read these few rows
    parts = base.groupBy("model", "version", "error").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"{c}_sum") for c in bounds],
        *[
            F.count_if(F.col(c) <= b).alias(f"{c}_{i}")
            for c, bs in bounds.items() for i, b in enumerate(bs)
        ],
        *[F.count(c).alias(f"{c}_{len(bs)}") for c, bs in bounds.items()],
    )

    def line(metric: str, label: Column, le: str | None, value: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"), label.alias("label"),
            F.lit(le).cast("string").alias("le"), value.cast("double").alias("value"),
        )

    lines = [
        line("predictions_total", F.concat_ws("/", "model", "version"), None, F.col("n")),
        F.when(F.col("error").isNotNull(),
               line("prediction_errors_total", F.concat_ws("/", "model", "error"), None, F.col("n"))),
    ]
    for c, bs in bounds.items():
        names = [f"{b:g}" for b in bs] + [INFINITY]
        lines += [line(f"{c}_bucket", F.lit(""), n, F.col(f"{c}_{i}")) for i, n in enumerate(names)]
        lines.append(line(f"{c}_sum", F.lit(""), None, F.col(f"{c}_sum")))
    long = parts.select(F.inline(F.array_compact(F.array(*lines))))
    return long.groupBy("metric", "label", "le").agg(F.sum("value").alias("value"))
