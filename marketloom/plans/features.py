"""Contracts, selection, feature lookup, analyst rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom import contracts
from marketloom.functions.columns import class_distribution, describe_features
from marketloom.operators import features as fs
from marketloom.operators import indicators as ind
from marketloom.operators import signals as sig
from marketloom.plans.market import INDICATOR_SQL, TARGET
from marketloom.plans.registry import query
from marketloom.plans.tables import (
    BARS_SQL,
    HOURLY_SQL,
    daily_bars,
    hourly_bars,
    rounded,
    stored_bars,
    table,
)
from marketloom.sources import bars as src


# --- selection ---------------------------------------------------------------------------------
@query(
    "wide_to_long",
    f"""WITH {BARS_SQL} SELECT date, ticker, open, high, low, close, volume FROM bars""",
)
def q_wide_to_long(spark, sf):
    bars = daily_bars(spark, sf)
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = bars.groupBy("date").agg(
        *[
            F.max(F.when(F.col("ticker") == t, F.col(f))).alias(f"{f.capitalize()}|{t}")
            for t in names
            for f in src.PRICE_FIELDS
        ]
    )
    return src.wide_to_long(wide)


@query(
    "single_ticker",
    """SELECT o_orderdate AS date, 'ALL' AS ticker, min(o_totalprice) AS low,
    max(o_totalprice) AS high, count(*)::BIGINT AS volume FROM orders GROUP BY 1""",
)
def q_single(spark, sf):
    one = table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("Date")).agg(
        F.max("o_totalprice").alias("High"), F.min("o_totalprice").alias("Low"),
        F.count(F.lit(1)).alias("Volume"), F.sum("o_totalprice").alias("Turnover"),
    )
    return src.single_ticker(one, "ALL")


@query(
    "ticker_list",
    """SELECT o_custkey, name FROM (SELECT o_custkey,
    unnest(string_split(o_orderpriority || ', ,' || o_orderstatus || ',', ',')) AS raw FROM orders),
    LATERAL (SELECT trim(raw) AS name) WHERE name <> ''""",
)
def q_ticker_list(spark, sf):
    text = F.concat("o_orderpriority", F.lit(", ,"), "o_orderstatus", F.lit(","))
    return table(spark, sf, "orders").select(
        "o_custkey", F.explode(src.ticker_list(text)).alias("name")
    )


@query(
    "ingest_stats",
    f"""WITH {BARS_SQL} SELECT count(*)::BIGINT AS n_rows, count(DISTINCT ticker)::BIGINT AS n_tickers,
    min(date) AS first_date, max(date) AS last_date FROM bars""",
)
def q_ingest_stats(spark, sf):
    return src.ingest_stats(daily_bars(spark, sf))


@query(
    "drop_nulls",
    f"""WITH {BARS_SQL}, d AS (SELECT ticker, date,
      close - lag(close) OVER (PARTITION BY ticker ORDER BY date) AS diff FROM bars)
    SELECT ticker, date, round(diff, 4) AS diff FROM d WHERE diff IS NOT NULL""",
)
def q_drop_nulls(spark, sf):
    out = ind.drop_nulls(ind.difference(stored_bars(spark, sf)), ["diff"])
    return rounded(out.select("ticker", "date", "diff"))


@query(
    "ticker_filter",
    """SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderpriority = '5-LOW'""",
)
def q_ticker_filter(spark, sf):
    orders = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "5-LOW")
    return orders.select("o_orderkey", "o_totalprice", "o_orderdate")


@query(
    "period_filter",
    f"""WITH {BARS_SQL}, last AS (SELECT max(date) AS d FROM bars)
    SELECT '3mo' AS period, ticker, date, close FROM bars, last WHERE date > d - INTERVAL 3 MONTH
    UNION ALL SELECT '1y', ticker, date, close FROM bars, last WHERE date > d - INTERVAL 12 MONTH
    UNION ALL SELECT 'ytd', ticker, date, close FROM bars, last WHERE date >= date_trunc('year', d)
    UNION ALL SELECT 'max', ticker, date, close FROM bars""",
)
def q_period(spark, sf):
    bars = stored_bars(spark, sf)
    parts = [
        sig.period_filter(bars, p).select(F.lit(p).alias("period"), "ticker", "date", "close")
        for p in ("3mo", "1y", "ytd", "max")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "feature_projection",
    f"""WITH {BARS_SQL} SELECT ticker, date, close::FLOAT::DOUBLE AS close,
    volume::FLOAT::DOUBLE AS volume FROM bars""",
)
def q_projection(spark, sf):
    bars = daily_bars(spark, sf)
    view = fs.stock_view()
    served = view.project(bars, ["stock_features:close", "volume"])
    return served.withColumns({c: F.col(c).cast("double") for c in ("close", "volume")})


VIEW_ROWS = ", ".join(f"('stock_features', '{c}', 'float')" for c in fs.VIEW_FEATURES)


@query(
    "feature_view",
    f"""WITH {BARS_SQL}, v AS (SELECT * FROM (VALUES {VIEW_ROWS}, ('stock_features', 'target', 'bigint')) t(view, feature, type)),
    have AS (SELECT unnest(['open', 'high', 'low', 'close', 'volume']) AS feature, count(*)::BIGINT AS n FROM bars)
    SELECT view, v.feature, type, coalesce(n, 0) AS n_rows FROM v LEFT JOIN have USING (feature)""",
)
def q_view(spark, sf):
    """The served view, with the number of stored rows of each of its features."""
    bars = daily_bars(spark, sf)
    here = [c for c in fs.VIEW_FEATURES if c in bars.columns]
    counts = bars.agg(*[F.count(c).alias(c) for c in here]).unpivot([], here, "feature", "n_rows")
    joined = fs.stock_view().describe(spark).join(counts, "feature", "left")
    return joined.na.fill(0, ["n_rows"])


DATASET_SQL = " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS position, '{c}' AS feature, "
    f"'{'bigint' if c == 'volume' else 'double'}' AS type, count({c})::BIGINT AS n_values, "
    f"round(min({c})::DOUBLE, 4) AS least, round(max({c})::DOUBLE, 4) AS greatest FROM complete"
    for i, c in enumerate(["open", "high", "low", "close", "volume", *ind.INDICATOR_COLUMNS])
)


@query(
    "dataset_features",
    f"""{INDICATOR_SQL}, complete AS (SELECT * FROM indicators
      WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ind.INDICATOR_COLUMNS)}) {DATASET_SQL}""",
)
def q_dataset_features(spark, sf):
    return rounded(describe_features(ind.training_table(stored_bars(spark, sf))))


@query(
    "class_distribution",
    f"""WITH {BARS_SQL}, t AS (SELECT {TARGET} FROM bars)
    SELECT target, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
    FROM t GROUP BY target""",
)
def q_classes(spark, sf):
    return rounded(class_distribution(ind.add_target(stored_bars(spark, sf))), 6)


# --- contracts ---------------------------------------------------------------------------------
@query(
    "dq_coerce",
    """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS close,
    try_cast(event_type AS BIGINT) AS volume,
    (try_cast(event_type AS BIGINT) IS NULL) AS bad_volume FROM events""",
)
def q_coerce(spark, sf):
    raw = table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("close"), F.col("event_type").alias("volume")
    )
    marked = contracts.quarantine(raw, contracts.RAW).select(
        "event_id", F.array_contains("broken", "volume:castable").alias("bad_volume")
    )
    return contracts.coerce(raw, contracts.RAW).join(marked, "event_id")


@query(
    "contract_report",
    """SELECT 'date' AS "column", 'castable' AS rule, 0::BIGINT AS violations
    UNION ALL SELECT 'date', 'not_null', 0
    UNION ALL SELECT 'ticker', 'castable', 0 UNION ALL SELECT 'ticker', 'not_null', 0
    UNION ALL SELECT 'open', 'castable', count(*) FROM events
    UNION ALL SELECT 'open', 'not_null', 0
    UNION ALL SELECT 'volume', 'castable', 0
    UNION ALL SELECT 'volume', 'not_null', count_if(value <= 20) FROM events
    UNION ALL SELECT unnest(['high', 'low', 'close']), 'present', 1""",
)
def q_contract_report(spark, sf):
    raw = table(spark, sf, "events").select(
        F.col("ts").alias("date"), F.col("event_type").alias("ticker"), F.col("props").alias("open"),
        F.when(F.col("value") > 20, F.col("user_id")).alias("volume"),
    )
    return contracts.contract_report(raw, contracts.RAW)


@query(
    "dq_null_report",
    f"""{INDICATOR_SQL} SELECT c AS "column", n::BIGINT AS missing FROM (
    SELECT {', '.join(f'count(*) - count({c}) AS {c}' for c in ind.INDICATOR_COLUMNS)}
    FROM indicators) UNPIVOT (n FOR c IN ({', '.join(ind.INDICATOR_COLUMNS)}))""",
)
def q_null_report(spark, sf):
    return contracts.null_report(ind.add_indicators(stored_bars(spark, sf)), ind.INDICATOR_COLUMNS)


@query(
    "dq_rules",
    """SELECT 'open' AS "column", 'positive' AS rule, count_if(NOT (l_discount > 0))::BIGINT AS violations
    FROM lineitem
    UNION ALL SELECT 'high', 'positive', count_if(NOT (l_quantity > 0)) FROM lineitem
    UNION ALL SELECT 'low', 'positive', count_if(NOT (l_tax > 0)) FROM lineitem
    UNION ALL SELECT 'close', 'positive', count_if(NOT (l_extendedprice > 0)) FROM lineitem
    UNION ALL SELECT 'high', 'not_below_low', count_if(l_quantity < l_tax) FROM lineitem
    UNION ALL SELECT 'rsi_14', 'between_0_and_100', count_if(NOT (l_extendedprice / 1000 BETWEEN 0 AND 100)) FROM lineitem
    UNION ALL SELECT 'target', 'zero_or_one', count_if(l_linenumber NOT IN (0, 1)) FROM lineitem
    UNION ALL SELECT 'ticker,date', 'unique', count(*) FROM (
      SELECT 1 FROM lineitem GROUP BY l_partkey, l_shipdate HAVING count(*) > 1)""",
)
def q_rules(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("ticker"), F.col("l_shipdate").alias("date"),
        F.col("l_discount").alias("open"), F.col("l_quantity").alias("high"),
        F.col("l_tax").alias("low"), F.col("l_extendedprice").alias("close"),
        (F.col("l_extendedprice") / 1000).alias("rsi_14"), F.col("l_linenumber").alias("target"),
    )
    return contracts.rule_report(rows)


# --- feature lookup ----------------------------------------------------------------------------
@query(
    "asof_features",
    f"""WITH {HOURLY_SQL}, f AS (SELECT * FROM hourly WHERE hour(date) < 6)
    SELECT e.event_id, e.event_type AS ticker, e.ts AS event_timestamp,
      CASE WHEN f.date >= e.ts - INTERVAL 6 HOUR THEN f.date END AS feature_date,
      CASE WHEN f.date >= e.ts - INTERVAL 6 HOUR THEN f.close END AS close,
      CASE WHEN f.date >= e.ts - INTERVAL 6 HOUR THEN f.volume END AS volume
    FROM events e ASOF LEFT JOIN f ON e.event_type = f.ticker AND e.ts >= f.date""",
)
def q_asof(spark, sf):
    """Night bars only and a ttl of six hours, so that part of the requests find nothing."""
    entities = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("ticker"), F.col("ts").alias("event_timestamp")
    )
    night = hourly_bars(spark, sf).filter(F.hour("date") < 6)
    return fs.asof_features(entities, night, ["close", "volume"], ttl_seconds=6 * 3600)


@query(
    "asof_features_hourly",
    f"""WITH {HOURLY_SQL}, f AS (SELECT *, date + INTERVAL 1 HOUR AS known FROM hourly)
    SELECT e.event_id, e.event_type AS ticker, e.ts AS event_timestamp,
      CASE WHEN f.known >= e.ts - INTERVAL 6 HOUR THEN f.known END AS feature_known,
      CASE WHEN f.known >= e.ts - INTERVAL 6 HOUR THEN f.close END AS close,
      CASE WHEN f.known >= e.ts - INTERVAL 6 HOUR THEN f.volume END AS volume
    FROM events e ASOF LEFT JOIN f ON e.event_type = f.ticker AND e.ts >= f.known""",
)
def q_asof_hourly(spark, sf):
    """All hourly bars, each known when its hour has ended."""
    entities = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("ticker"), F.col("ts").alias("event_timestamp")
    )
    bars = hourly_bars(spark, sf).withColumn("known", F.col("date") + F.expr("INTERVAL 1 HOUR")).drop("date")
    return fs.asof_features(entities, bars, ["close", "volume"], ttl_seconds=6 * 3600, order="known")


@query(
    "asof_features_daily",
    f"""WITH {BARS_SQL} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
      CASE WHEN b.date >= e.ts - INTERVAL 1 DAY THEN b.date END AS feature_date,
      CASE WHEN b.date >= e.ts - INTERVAL 1 DAY THEN b.close END AS close
    FROM (SELECT *, l_shipdate + INTERVAL 1 HOUR * l_quantity AS ts FROM lineitem JOIN orders
          ON o_orderkey = l_orderkey) e
    ASOF LEFT JOIN bars b ON e.o_orderpriority = b.ticker AND e.ts >= b.date""",
)
def q_asof_daily(spark, sf):
    """Every line item asks for the bar of its order's priority at a time after shipping."""
    lines = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    at = F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_quantity").cast("int"))
    entities = lines.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"),
        F.col("o_orderpriority").alias("ticker"), at.alias("event_timestamp"),
    )
    out = fs.asof_features(entities, daily_bars(spark, sf), ["close"])
    return out.drop("ticker", "event_timestamp")


LAST = "QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1"


@query("latest_per_ticker", f"WITH {HOURLY_SQL} SELECT * FROM hourly {LAST}")
def q_latest(spark, sf):
    return fs.latest_per_key(hourly_bars(spark, sf))


@query(
    "online_features",
    f"""WITH {HOURLY_SQL}, latest AS (SELECT * FROM hourly {LAST}),
    requests AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE event_type END AS ticker
                 FROM events)
    SELECT event_id, ticker, date, close, volume FROM requests LEFT JOIN latest USING (ticker)""",
)
def q_online(spark, sf):
    name = F.when(F.col("event_id") % 7 == 0, "unknown").otherwise(F.col("event_type"))
    requests = table(spark, sf, "events").select("event_id", name.alias("ticker"))
    latest = fs.latest_per_key(hourly_bars(spark, sf)).select("ticker", "date", "close", "volume")
    return fs.online_features(requests, latest)


@query(
    "materialize",
    f"""WITH {HOURLY_SQL} SELECT * FROM hourly
    WHERE date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' {LAST}""",
)
def q_materialize(spark, sf):
    return fs.materialize(hourly_bars(spark, sf), "2024-01-05", "2024-01-20")


@query("materialize_incremental", f"WITH {HOURLY_SQL} SELECT * FROM hourly {LAST}")
def q_incremental(spark, sf):
    bars = hourly_bars(spark, sf)
    return fs.materialize_incremental(fs.materialize(bars, None, "2024-01-20"), bars)


@query(
    "feature_fallback",
    f"""WITH {HOURLY_SQL}, online AS (SELECT * FROM hourly WHERE ticker IN ('click', 'view') {LAST}),
    stored AS (SELECT * FROM hourly WHERE ticker <> 'signup' AND date < TIMESTAMP '2024-01-10' {LAST}),
    requests AS (SELECT DISTINCT event_type AS ticker FROM events)
    SELECT r.ticker, CASE WHEN o.ticker IS NOT NULL THEN 'online' WHEN s.ticker IS NOT NULL
           THEN 'stored' ELSE 'not_found' END AS source,
           coalesce(o.date, s.date) AS date, coalesce(o.close, s.close) AS close
    FROM requests r LEFT JOIN online o USING (ticker) LEFT JOIN stored s USING (ticker)""",
)
def q_fallback(spark, sf):
    bars = hourly_bars(spark, sf)
    requests = table(spark, sf, "events").select(F.col("event_type").alias("ticker")).distinct()
    online = fs.latest_per_key(bars.filter(F.col("ticker").isin("click", "view")))
    stored = bars.filter(
        (F.col("ticker") != "signup") & (F.col("date") < F.lit("2024-01-10").cast("timestamp_ntz"))
    )
    return fs.features_with_fallback(requests, online, stored, ["date", "close"])


# --- analyst rules -----------------------------------------------------------------------------
def summary_sql(period: str, condition: str) -> str:
    return f"""
summary AS (
  SELECT ticker, '{period}' AS period, round_even(arg_max(close, date), 2) AS current_price,
    round_even(arg_min(close, date), 2) AS start_price, round_even(max(high), 2) AS high_price,
    round_even(min(low), 2) AS low_price,
    round_even(arg_max(close, date) - arg_min(close, date), 2) AS price_change,
    round_even((arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) * 100, 2)
      AS price_change_pct,
    trunc(avg(volume))::BIGINT AS avg_volume, count(*)::BIGINT AS data_points
  FROM bars WHERE {condition} GROUP BY ticker)"""


MONTHS = "date > (SELECT max(date) FROM bars) - INTERVAL {} MONTH"


@query("price_summary", f"WITH {BARS_SQL}, {summary_sql('1mo', MONTHS.format(1))} SELECT * FROM summary")
def q_summary(spark, sf):
    return sig.price_summary(stored_bars(spark, sf), "1mo")


RANKED = """
ranked AS (
  SELECT *, row_number() OVER (ORDER BY price_change_pct DESC, ticker) AS rank,
    row_number() OVER (ORDER BY price_change_pct DESC, ticker) = 1 AS is_best,
    row_number() OVER (ORDER BY price_change_pct, ticker DESC) = 1 AS is_worst FROM summary)"""


@query(
    "compare_stocks",
    f"""WITH {BARS_SQL}, {summary_sql('1y', MONTHS.format(12))}, {RANKED}
    SELECT ticker, period, price_change_pct, rank, is_best, is_worst, data_points FROM ranked""",
)
def q_compare(spark, sf):
    out = sig.compare_stocks(stored_bars(spark, sf), "1y")
    return out.select(
        "ticker", "period", "price_change_pct", "rank", "is_best", "is_worst", "data_points"
    )


@query(
    "compare_top3",
    f"""WITH {BARS_SQL}, {summary_sql('1y', MONTHS.format(12))}, {RANKED}
    SELECT ticker, rank, (CASE WHEN price_change_pct >= 0 THEN '+' ELSE '-' END) ||
           printf('%.2f', abs(price_change_pct)) || '%' AS change FROM ranked WHERE rank <= 3""",
)
def q_compare_top3(spark, sf):
    out = sig.compare_stocks(stored_bars(spark, sf), "1y").filter("rank <= 3")
    return out.select("ticker", "rank", sig.signed_percent(F.col("price_change_pct")).alias("change"))


SNAP_COLUMNS = ["rsi_14", "sma_20", "sma_50", "ema_12", "ema_26", "macd", "bb_upper", "bb_middle",
                "bb_lower"]


def snapshot_sql(months: int) -> str:
    recent = INDICATOR_SQL.replace("\nbars AS (", "\nall_bars AS (", 1).replace(
        "FROM orders GROUP BY 1, 2)",
        "FROM orders GROUP BY 1, 2),\nbars AS (SELECT * FROM all_bars WHERE date > "
        f"(SELECT max(date) FROM all_bars) - INTERVAL {months} MONTH)",
        1,
    )
    values = ", ".join(
        f"CASE WHEN n >= 50 THEN round_even({c}, 2) END AS {c}" for c in SNAP_COLUMNS
    )
    return f"""{recent},
latest AS (SELECT * FROM indicators {LAST}),
sizes AS (SELECT ticker, count(*) AS n FROM bars GROUP BY ticker),
snapshot AS (
  SELECT ticker, n::BIGINT AS data_points,
    CASE WHEN n >= 50 THEN round_even(close, 2) END AS current_price, {values},
    CASE WHEN n >= 50 THEN
      (CASE WHEN rsi_14 > 70 THEN 'overbought' WHEN rsi_14 < 30 THEN 'oversold'
       ELSE 'neutral RSI' END) || ', ' ||
      (CASE WHEN close > sma_20 AND sma_20 > sma_50 THEN 'bullish trend'
       WHEN close < sma_20 AND sma_20 < sma_50 THEN 'bearish trend' ELSE 'mixed trend' END)
    END AS signal,
    CASE WHEN n < 50 THEN 'Insufficient data for ' || ticker END AS error
  FROM latest JOIN sizes USING (ticker))"""


DECISION_SQL = """
points AS (
  SELECT *,
    CASE WHEN rsi_14 < 30 THEN 2 WHEN rsi_14 > 70 THEN -2 WHEN rsi_14 > 50 THEN 1 ELSE -1 END AS a,
    CASE WHEN current_price > sma_20 AND sma_20 > sma_50 THEN 2
         WHEN current_price < sma_20 AND sma_20 < sma_50 THEN -2
         WHEN current_price > sma_20 THEN 1 ELSE -1 END AS b
  FROM snapshot WHERE error IS NULL),
scored AS (
  SELECT *, (greatest(a, 0) + greatest(b, 0))::BIGINT AS bullish,
    (greatest(-a, 0) + greatest(-b, 0))::BIGINT AS bearish,
    (greatest(a, 0) + greatest(b, 0)) / (abs(a) + abs(b)) AS p FROM points),
decided AS (
  SELECT ticker, bullish, bearish, CASE WHEN p > 0.5 THEN 'valorização' ELSE 'desvalorização' END AS prediction,
    round_even(p * 100, 2) AS probability_up, round_even((1 - p) * 100, 2) AS probability_down,
    CASE WHEN abs(p - 0.5) > 0.15 THEN 'moderada' ELSE 'baixa' END AS confidence,
    'Technical Indicators (Fallback)' AS model,
    CASE WHEN p > 0.7 THEN 'COMPRA FORTE - Alta probabilidade de valorização'
         WHEN p > 0.6 THEN 'COMPRA - Probabilidade moderada de valorização'
         ELSE 'NEUTRO - Incerteza alta, aguardar melhores sinais' END AS recommendation,
    CASE WHEN current_price > sma_20 THEN 'acima' ELSE 'abaixo' END AS price_vs_sma20,
    CASE WHEN current_price > sma_50 THEN 'acima' ELSE 'abaixo' END AS price_vs_sma50
  FROM scored)"""


@query("indicator_snapshot", f"{snapshot_sql(3)} SELECT * FROM snapshot")
def q_snapshot(spark, sf):
    return sig.indicator_snapshot(stored_bars(spark, sf), "3mo")


@query("rule_score", f"{snapshot_sql(12)}, {DECISION_SQL} SELECT * FROM decided")
def q_rule_score(spark, sf):
    return sig.rule_score(sig.indicator_snapshot(stored_bars(spark, sf), "1y"))


@query(
    "interpret",
    f"""{INDICATOR_SQL} SELECT ticker, date,
      (CASE WHEN rsi_14 > 70 THEN 'overbought' WHEN rsi_14 < 30 THEN 'oversold'
       ELSE 'neutral RSI' END) || ', ' ||
      (CASE WHEN close > sma_20 AND sma_20 > sma_50 THEN 'bullish trend'
       WHEN close < sma_20 AND sma_20 < sma_50 THEN 'bearish trend' ELSE 'mixed trend' END) AS signal
    FROM indicators""",
)
def q_interpret(spark, sf):
    rows = ind.add_indicators(stored_bars(spark, sf))
    text = sig.interpret(F.col("rsi_14"), F.col("close"), F.col("sma_20"), F.col("sma_50"))
    return rows.select("ticker", "date", text.alias("signal"))


@query(
    "recommend",
    """WITH p AS (SELECT event_id, value / 500 AS p, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS up
    FROM events)
    SELECT event_id, CASE WHEN p > 0.7 AND up = 1 THEN 'COMPRA FORTE - Alta probabilidade de valorização'
      WHEN p > 0.7 THEN 'VENDA FORTE - Alta probabilidade de desvalorização'
      WHEN p > 0.6 AND up = 1 THEN 'COMPRA - Probabilidade moderada de valorização'
      WHEN p > 0.6 THEN 'VENDA - Probabilidade moderada de desvalorização'
      ELSE 'NEUTRO - Incerteza alta, aguardar melhores sinais' END AS recommendation,
      CASE WHEN p > 0.6 THEN 'buy' WHEN p < 0.4 THEN 'sell' ELSE 'neutral' END AS band FROM p""",
)
def q_recommend(spark, sf):
    p = F.col("value") / 500
    up = F.when(F.col("user_id") % 2 == 0, 1).otherwise(0)
    return table(spark, sf, "events").select(
        "event_id", sig.recommend(up, p).alias("recommendation"), sig.prediction_band(p).alias("band")
    )


@query(
    "decide",
    f"""{snapshot_sql(12)}, {DECISION_SQL},
    model AS (SELECT o_orderpriority AS ticker, avg((o_orderstatus = 'F')::INT::DOUBLE) AS p FROM orders
      WHERE o_orderpriority < '3' GROUP BY 1)
    SELECT coalesce(m.ticker, d.ticker) AS ticker,
      CASE WHEN m.ticker IS NULL THEN d.prediction WHEN m.p > 0.5 THEN 'valorização' ELSE 'desvalorização' END AS prediction,
      CASE WHEN m.ticker IS NULL THEN d.probability_up ELSE round_even(m.p * 100, 2) END AS probability_up,
      CASE WHEN m.ticker IS NULL THEN d.confidence WHEN abs(m.p - 0.5) > 0.2 THEN 'alta' ELSE 'moderada' END AS confidence,
      CASE WHEN m.ticker IS NULL THEN d.model ELSE 'LSTM' END AS model
    FROM decided d FULL JOIN model m ON m.ticker = d.ticker""",
)
def q_decide(spark, sf):
    p = F.avg((F.col("o_orderstatus") == "F").cast("double"))
    predictions = (
        table(spark, sf, "orders").filter(F.col("o_orderpriority") < "3")
        .groupBy(F.col("o_orderpriority").alias("ticker")).agg(p.alias("probability"))
        .withColumn("prediction", (F.col("probability") > 0.5).cast("int"))
    )
    snapshot = sig.indicator_snapshot(stored_bars(spark, sf), "1y")
    out = sig.decide(snapshot, predictions)
    return out.select("ticker", "prediction", "probability_up", "confidence", "model")


@query(
    "analysis_text",
    f"""{snapshot_sql(12)}, {summary_sql('1mo', MONTHS.format(1)).replace('FROM bars', 'FROM all_bars')
        .replace('(SELECT max(date) FROM bars)', '(SELECT max(date) FROM all_bars)')}
    SELECT s.ticker, 'Análise de ' || s.ticker || ' | Cotação Atual: R$ ' ||
      printf('%.2f', s.current_price) || ' | Variação: ' ||
      (CASE WHEN price_change_pct >= 0 THEN '+' ELSE '-' END) || printf('%.2f', abs(price_change_pct))
      || '% | Preço: R$ ' || printf('%.2f', low_price) || ' - R$ ' || printf('%.2f', high_price) ||
      ' | RSI (14): ' || coalesce(printf('%.2f', rsi_14), 'N/A') || ' - ' || coalesce(signal, 'N/A') ||
      ' | MACD: ' || coalesce(printf('%.2f', macd), 'N/A') ||
      ' | SMA20: R$ ' || coalesce(printf('%.2f', sma_20), 'N/A') ||
      ' | SMA50: R$ ' || coalesce(printf('%.2f', sma_50), 'N/A') AS analysis
    FROM summary s LEFT JOIN snapshot n USING (ticker)""",
)
def q_analysis(spark, sf):
    bars = stored_bars(spark, sf)
    return sig.analysis_text(sig.price_summary(bars, "1mo"), sig.indicator_snapshot(bars, "1y"))
