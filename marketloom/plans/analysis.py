"""Drift, model preparation and metrics, exploration of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions.columns import feature_columns
from marketloom.jobs import drift_job, feature_job
from marketloom.operators import drift as dr
from marketloom.operators import indicators as ind
from marketloom.operators import models as ml
from marketloom.operators import profiles
from marketloom.operators import timeseries as ts
from marketloom.operators.signals import prediction_band
from marketloom.plans.market import INDICATOR_SQL, TARGET
from marketloom.plans.registry import query
from marketloom.plans.tables import BARS_SQL, daily_bars, rounded, stored_bars, table
from marketloom.session import stage, work_path

# --- drift -------------------------------------------------------------------------------------
LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
SHIP_CUT = "1998-01-01"


def line_samples(spark, sf):
    """Line items shipped before and after a date; two few-valued columns join the numeric ones."""
    lines = table(spark, sf, "lineitem").withColumns(
        {
            "l_returned": (F.col("l_returnflag") == "R").cast("long"),
            "l_halves": F.floor(F.col("l_quantity") / 20),
        }
    )
    old = F.col("l_shipdate") < F.lit(SHIP_CUT).cast("timestamp_ntz")
    return lines.filter(old), lines.filter(~old), [*LINE_COLUMNS, "l_returned", "l_halves"]


def label_samples(spark, sf):
    """Labelled documents in two halves by source: a small reference sample."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn(
        "n_lang", F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2)
        .when(F.col("lang") == "fr", 3).otherwise(4)
    )
    early = F.col("source") < "src12"
    return docs.filter(early), docs.filter(~early), ["n_chars", "quality", "toxic", "n_lang"]


LINE_LONG = f"""
lines AS (
  SELECT *, (l_returnflag = 'R')::INT AS l_returned, floor(l_quantity / 20) AS l_halves,
         l_shipdate < TIMESTAMP '{SHIP_CUT}' AS old FROM lineitem),
long AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS col, {c}::DOUBLE AS v, old FROM lines"
                      for c in [*LINE_COLUMNS, 'l_returned', 'l_halves'])})"""

LABEL_LONG = """
lines AS (
  SELECT d.*, l.quality, l.toxic, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3
    ELSE 4 END AS n_lang, source < 'src12' AS old FROM documents d JOIN labels l USING (doc_id)),
long AS (
  SELECT 'n_chars' AS col, n_chars::DOUBLE AS v, old FROM lines
  UNION ALL SELECT 'quality', quality, old FROM lines
  UNION ALL SELECT 'toxic', toxic, old FROM lines
  UNION ALL SELECT 'n_lang', n_lang, old FROM lines)"""

MEASURES = """
counts AS (
  SELECT col, v, count_if(old) AS r, count_if(NOT old) AS c FROM long GROUP BY col, v),
cum AS (
  SELECT *, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER t AS nr, sum(c) OVER t AS nc,
    lead(v) OVER (PARTITION BY col ORDER BY v) AS nv
  FROM counts WINDOW w AS (PARTITION BY col ORDER BY v), t AS (PARTITION BY col)),
sums AS (
  SELECT col, max(nr)::DOUBLE AS nr, max(nc)::DOUBLE AS nc, count(*) AS k,
    max(abs(cr / nr - cc / nc)) AS d,
    sum(abs(cr / nr - cc / nc) * (coalesce(nv, v) - v)) AS w1,
    sum(CASE WHEN r > 0 THEN (c - r * nc / nr) ** 2 / (r * nc / nr) WHEN c > 0 THEN 'infinity'::DOUBLE ELSE 0 END) AS chi2,
    sqrt(sum(CASE WHEN r > 0 THEN r / nr * ln((r / nr) / ((r / nr + c / nc) / 2)) ELSE 0 END +
             CASE WHEN c > 0 THEN c / nc * ln((c / nc) / ((r / nr + c / nc) / 2)) ELSE 0 END) / 2) AS js,
    arg_max(r / nr, v) AS pr, arg_max(c / nc, v) AS pc
  FROM cum GROUP BY col),
devs AS (SELECT col, stddev_pop(v) AS dev FROM long WHERE old GROUP BY col),
measures AS (
  SELECT *, w1 / greatest(dev, 0.001) AS wn,
    (pr - pc) / sqrt(((pr * nr + pc * nc) / (nr + nc)) * (1 - (pr * nr + pc * nc) / (nr + nc))
                     * (1 / nr + 1 / nc)) AS z,
    d * d * nr * nc / (nr + nc) AS x2
  FROM sums JOIN devs USING (col)),
pvalues AS (
  SELECT *, CASE WHEN x2 < 0.02 THEN 1.0 ELSE greatest(0, least(1, 2 * list_sum(list_transform(
      range(1, 101), lambda i: (CASE WHEN i % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE * exp(-2 * i * i * x2)
    )))) END AS ks_p,
    1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda i:
      (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE * pow(abs(z) / sqrt(2), 2 * i + 1)
      / gamma(i + 1) / (2 * i + 1))) AS z_p,
    CASE WHEN chi2 = 0 THEN 1.0 WHEN isinf(chi2) THEN 0.0 ELSE 1 - list_sum(list_transform(range(0, 300), lambda i:
      exp(((k - 1) / 2 + i) * ln(chi2 / 2) - chi2 / 2 - lgamma((k - 1) / 2 + i + 1)))) END AS chi_p
  FROM measures)"""


@query(
    "drift_ks",
    f"""WITH {LINE_LONG}, {MEASURES} SELECT col AS "column", round(d, 6) AS ks_d,
    round(ks_p, 6) AS p_value FROM pvalues""",
)
def q_ks(spark, sf):
    return rounded(dr.drift_ks(*line_samples(spark, sf)), 6)


@query(
    "drift_wasserstein",
    f"""WITH {LINE_LONG}, {MEASURES} SELECT col AS "column", round(w1, 4) AS w1,
    round(wn, 6) AS wasserstein FROM measures""",
)
def q_wasserstein(spark, sf):
    out = dr.drift_wasserstein(*line_samples(spark, sf))
    return out.select("column", F.round("w1", 4).alias("w1"), F.round("wasserstein", 6).alias("wasserstein"))


@query(
    "drift_chi2",
    """WITH long AS (SELECT 'l_returnflag' AS col, l_returnflag AS v, l_linestatus = 'O' AS cur FROM lineitem
      UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, l_linestatus = 'O' FROM lineitem),
    counts AS (SELECT col, v, count_if(NOT cur) AS r, count_if(cur) AS c FROM long GROUP BY 1, 2),
    t AS (SELECT *, sum(r) OVER (PARTITION BY col) AS nr, sum(c) OVER (PARTITION BY col) AS nc FROM counts)
    , m AS (SELECT col, sum((c - r * nc / nr) ** 2 / (r * nc / nr)) AS chi2, count(*) AS k FROM t GROUP BY col)
    SELECT col AS "column", round(chi2, 6) AS chi2, (k - 1)::BIGINT AS dof,
      round(CASE WHEN chi2 = 0 THEN 1.0 ELSE greatest(0, 1 - list_sum(list_transform(range(0, 400), lambda i:
        exp(((k - 1) / 2 + i) * ln(chi2 / 2) - chi2 / 2 - lgamma((k - 1) / 2 + i + 1))))) END, 6) AS p_value FROM m""",
)
def q_chi2(spark, sf):
    lines = table(spark, sf, "lineitem")
    current = F.col("l_linestatus") == "O"
    out = dr.drift_chi2(
        lines.filter(~current), lines.filter(current), ["l_returnflag", "l_linenumber"]
    )
    return rounded(out.select("column", "chi2", "dof", "p_value"), 6)


@query(
    "drift_psi",
    f"""WITH {LINE_LONG},
    edges AS (SELECT col, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e
              FROM long WHERE old GROUP BY col),
    placed AS (SELECT col, old, len(list_filter(e, lambda x: x <= v)) AS b FROM long JOIN edges USING (col)),
    totals AS (SELECT col, count_if(old) AS nr, count_if(NOT old) AS nc FROM long GROUP BY col),
    shares AS (SELECT col, b, greatest(count_if(old) / max(nr), 1e-4::DOUBLE) AS p,
               greatest(count_if(NOT old) / max(nc), 1e-4::DOUBLE) AS q FROM placed JOIN totals USING (col)
               GROUP BY col, b)
    SELECT col AS "column", round(sum((p - q) * ln(p / q)), 6) AS psi FROM shares GROUP BY col""",
)
def q_psi(spark, sf):
    return rounded(dr.drift_psi(*line_samples(spark, sf)), 6)


@query(
    "drift_js",
    """WITH long AS (SELECT 'l_returnflag' AS col, l_returnflag AS v, l_linestatus = 'O' AS cur FROM lineitem
      UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, l_linestatus = 'O' FROM lineitem),
    counts AS (SELECT col, v, count_if(NOT cur) AS r, count_if(cur) AS c FROM long GROUP BY 1, 2),
    t AS (SELECT col, r / sum(r) OVER (PARTITION BY col) AS p, c / sum(c) OVER (PARTITION BY col) AS q FROM counts)
    SELECT col AS "column", round(sqrt(sum(
      CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END +
      CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2), 6) AS js FROM t GROUP BY col""",
)
def q_js(spark, sf):
    lines = table(spark, sf, "lineitem")
    current = F.col("l_linestatus") == "O"
    return rounded(
        dr.drift_js(lines.filter(~current), lines.filter(current), ["l_returnflag", "l_linenumber"]), 6
    )


@query(
    "drift_z",
    f"""WITH {LABEL_LONG}, {MEASURES} SELECT col AS "column", round(z, 6) AS z,
    round(z_p, 6) AS p_value FROM pvalues WHERE col IN ('quality', 'toxic')""",
)
def q_z(spark, sf):
    old, new, _ = label_samples(spark, sf)
    return rounded(dr.drift_z(old, new, ["quality", "toxic"]), 6)


LINE_TESTS = {"l_returned": "jensenshannon", "l_halves": "jensenshannon", "l_tax": "ks"}
LABEL_TESTS = {"quality": "z", "toxic": "z", "n_lang": "chi2", "n_chars": "ks"}


def table_sql(tests):
    """SQL of the drift table; columns without a named test take the distance of numbers."""
    cases = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in tests.items())
    test = f"CASE col {cases} ELSE 'wasserstein' END" if tests else "'wasserstein'"
    return f"""
picked AS (
  SELECT col, {test} AS test, *
  FROM pvalues),
scores AS (
  SELECT col, test, CASE test WHEN 'z' THEN z_p WHEN 'chi2' THEN chi_p WHEN 'ks' THEN ks_p
    WHEN 'jensenshannon' THEN js ELSE wn END AS score FROM picked),
flags AS (
  SELECT *, CASE WHEN test IN ('z', 'chi2', 'ks') THEN score < 0.05 ELSE score >= 0.05 END AS drifted
  FROM scores)"""


LINE_TABLE, LABEL_TABLE = table_sql(LINE_TESTS), table_sql(LABEL_TESTS)


@query(
    "drift_table",
    f"""WITH {LINE_LONG}, {MEASURES}, {LINE_TABLE} SELECT col AS "column", test,
    round(score, 6) AS score, drifted FROM flags""",
)
def q_table(spark, sf):
    return rounded(dr.drift_table(*line_samples(spark, sf), tests=LINE_TESTS), 6)


@query(
    "drift_table_labels",
    f"""WITH {LABEL_LONG}, {MEASURES}, {LABEL_TABLE} SELECT col AS "column", test,
    round(score, 6) AS score, drifted FROM flags""",
)
def q_table_small(spark, sf):
    return rounded(dr.drift_table(*label_samples(spark, sf), tests=LABEL_TESTS), 6)


SUMMARY = """
SELECT avg(drifted::INT) >= 0.5 AS drift_detected,
  round(avg(drifted::INT), 6) AS overall_drift_score,
  CASE WHEN avg(drifted::INT) < 0.2 THEN 'green' WHEN avg(drifted::INT) < 0.5 THEN 'yellow'
    ELSE 'red' END AS alert_level,
  coalesce(string_agg(CASE WHEN drifted THEN col END, ',' ORDER BY col), '') AS features_drifted,
  string_agg(col || '=' || CAST(CAST(round(score * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY col) AS drift_scores
FROM flags"""


def summary_columns(summary):
    """Array and map as text, for the comparison."""
    scores = F.transform(
        F.array_sort(F.map_entries("drift_scores")),
        lambda e: F.concat_ws("=", e["key"], F.round(e["value"] * 1000).cast("long")),
    )
    return summary.select(
        "drift_detected", F.round("overall_drift_score", 6).alias("overall_drift_score"),
        "alert_level", F.array_join("features_drifted", ",").alias("features_drifted"),
        F.array_join(scores, ",").alias("drift_scores"),
    )


@query("drift_summary", f"WITH {LINE_LONG}, {MEASURES}, {LINE_TABLE} {SUMMARY}")
def q_drift_summary(spark, sf):
    return summary_columns(dr.drift_summary(dr.drift_table(*line_samples(spark, sf), tests=LINE_TESTS)))


REPORT_COLUMNS = ["open", "high", "low", "close", "volume", *ind.INDICATOR_COLUMNS, "target"]


SPLIT = f"""
{BARS_SQL}, ordered AS (
  SELECT *, row_number() OVER (ORDER BY {{}}) - 1 AS pos, count(*) OVER () AS n FROM bars)"""


PROFILED = ["l_quantity", "l_extendedprice", "l_discount"]
PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


def monthly_profiles(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("month", F.date_trunc("month", "l_shipdate"))
    return stage(profiles.profile(lines, PROFILED, "month"), "profiles")


@query(
    "profile_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column, count({c})::BIGINT AS count, round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max, true AS quantiles_close FROM lineitem"""
        for c in PROFILED
    ),
)
def q_profile_describe(spark, sf):
    """Monthly profiles merged; are the quantiles within the stated error of the rows' ranks?"""
    described = profiles.describe_profiles(monthly_profiles(spark, sf), PROBS)
    errors = profiles.rank_errors(table(spark, sf, "lineitem"), PROFILED, described, PROBS)
    close = errors.groupBy("column").agg((F.max("error") <= profiles.RANK_ERROR).alias("quantiles_close"))
    return rounded(described.drop("quantiles").join(close, "column"))


@query("profile_drift")
def q_profile_drift(spark, sf):
    stored = monthly_profiles(spark, sf)
    old = F.col("period") < F.lit("1996-01-01").cast("timestamp_ntz")
    return profiles.profile_drift(stored.filter(old), stored.filter(~old))


@query(
    "ordered_split",
    f"""WITH {SPLIT.format('ticker, date')} SELECT ticker, date,
    CASE WHEN pos < floor(n * 0.7) THEN 'reference' ELSE 'current' END AS side FROM ordered""",
)
def q_split(spark, sf):
    first, rest = dr.ordered_split(stored_bars(spark, sf))
    return first.select("ticker", "date", F.lit("reference").alias("side")).unionByName(
        rest.select("ticker", "date", F.lit("current").alias("side"))
    )


@query(
    "drift_report",
    f"""{INDICATOR_SQL}, complete AS (
      SELECT *, {TARGET} FROM indicators),
    ordered AS (
      SELECT *, row_number() OVER (ORDER BY date, ticker) - 1 AS pos, count(*) OVER () AS n
      FROM complete WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ind.INDICATOR_COLUMNS)}),
    sides AS (SELECT *, pos < floor(n * 0.7) AS old FROM ordered),
    long AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, round({c}::DOUBLE, 4) AS v, old FROM sides"
                                 for c in REPORT_COLUMNS)}),
    {MEASURES}, {table_sql({"target": "jensenshannon"})} {SUMMARY}""",
)
def q_report(spark, sf):
    """The training table split by date, then all features and the target compared."""
    data = stage(rounded(ind.training_table(stored_bars(spark, sf))), "training")
    first, rest = dr.ordered_split(data, by="date")
    table_ = dr.drift_table(first, rest, REPORT_COLUMNS, tests={"target": "jensenshannon"})
    return summary_columns(dr.drift_summary(table_))


@query(
    "feature_pipeline",
    f"""{INDICATOR_SQL}, kept AS (SELECT count(*) AS n FROM indicators
      WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ind.INDICATOR_COLUMNS)})
    SELECT count(DISTINCT ticker)::BIGINT AS tickers, count(*)::BIGINT AS rows_read,
      (count(*) - max(n))::BIGINT AS rows_dropped, max(n)::BIGINT AS rows_written FROM bars, kept""",
)
def q_feature_pipeline(spark, sf):
    source, target = work_path(spark, "bars"), work_path(spark, "features")
    daily_bars(spark, sf).write.parquet(source)
    return feature_job(spark, source, target)


@query(
    "drift_pipeline",
    f"""WITH {LINE_LONG}, {MEASURES}, {table_sql({})} {SUMMARY}""",
)
def q_drift_pipeline(spark, sf):
    """Two stored samples, all their numeric columns, the summary read back from its JSON."""
    old, new, columns = line_samples(spark, sf)
    paths = [work_path(spark, name) for name in ("reference", "current", "drift")]
    for sample, path in zip((old, new), paths):
        sample.select(*columns).write.parquet(path)
    return summary_columns(drift_job(spark, paths[0], paths[2], current=paths[1]))


# --- model preparation -------------------------------------------------------------------------
SCALED = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "standardize",
    f"""WITH f AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in SCALED)}
      FROM lineitem WHERE l_shipdate < TIMESTAMP '{SHIP_CUT}')
    SELECT l_orderkey, l_linenumber, {', '.join(f'round(({c} - m_{c}) / s_{c}, 6) AS {c}' for c in SCALED)}
    FROM lineitem, f""",
)
def q_standardize(spark, sf):
    lines = table(spark, sf, "lineitem")
    train = lines.filter(F.col("l_shipdate") < F.lit(SHIP_CUT).cast("timestamp_ntz"))
    out = ml.standardize(lines, SCALED, fit_on=train)
    return rounded(out.select("l_orderkey", "l_linenumber", *SCALED), 6)


@query(
    "stratified_split",
    """WITH h AS (SELECT o_orderkey, o_orderstatus,
      row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR || '|42')) - 1 AS pos,
      count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
    SELECT o_orderkey, o_orderstatus, CASE WHEN pos < ceil(n * 0.2::DOUBLE) THEN 'test'
      WHEN pos < ceil(n * 0.2::DOUBLE) + ceil((n - ceil(n * 0.2::DOUBLE)) * 0.2::DOUBLE) THEN 'validation'
      ELSE 'train' END AS part FROM h""",
)
def q_stratified(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return ml.stratified_split(orders, "o_orderstatus", "o_orderkey")


@query(
    "time_split",
    """WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderdate) - 1 AS pos, count(*) OVER () AS n FROM orders),
    c AS (SELECT max(CASE WHEN pos = floor(n * 0.6::DOUBLE) THEN o_orderdate END) AS a,
          max(CASE WHEN pos = floor(n * 0.8::DOUBLE) THEN o_orderdate END) AS b FROM p)
    SELECT o_orderkey, CASE WHEN o_orderdate < a THEN 'train' WHEN o_orderdate < b THEN 'validation'
      ELSE 'test' END AS part FROM orders, c""",
)
def q_time_split(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return ml.time_split(orders, "o_orderdate").select("o_orderkey", "part")


def scored_labels(spark, sf):
    """Two scores per labelled document, from its length and its number."""
    rows = table(spark, sf, "labels").join(
        table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    models = F.array(
        F.struct(F.lit("length").alias("model"), (F.least(F.col("n_chars"), F.lit(5000)) / 5000).alias("score")),
        F.struct(F.lit("number").alias("model"), ((F.col("doc_id") * 7919) % 101 / 100).alias("score")),
    )
    return rows.select("doc_id", F.col("quality").alias("label"), F.inline(models))


SCORED = """
scored AS (
  SELECT doc_id, quality AS label, 'length' AS model, least(n_chars, 5000) / 5000 AS score
  FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, quality, 'number', (doc_id * 7919) % 101 / 100
  FROM labels JOIN documents USING (doc_id))"""


def confusion_sql(keys: str, test: str, source: str = "scored") -> str:
    return f"""
counted AS (
  SELECT {keys}, count_if(label = 1 AND {test}) AS tp, count_if(label = 0 AND {test}) AS fp,
    count_if(label = 1 AND NOT ({test})) AS fn, count_if(label = 0 AND NOT ({test})) AS tn
  FROM {source} GROUP BY {keys}),
confusion AS (
  SELECT {keys}, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn,
    round(coalesce((tp + tn) / (tp + fp + fn + tn), 0), 6) AS accuracy,
    round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
    round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1
  FROM counted)"""


AUC = """
pairs AS (SELECT model, score, count_if(label = 1) AS p, count_if(label = 0) AS n FROM scored GROUP BY 1, 2),
ranks AS (SELECT *, sum(n) OVER (PARTITION BY model ORDER BY score) - n / 2 AS below FROM pairs),
auc AS (SELECT model, round(sum(p * below) / (sum(p) * sum(n)), 6) AS roc_auc FROM ranks GROUP BY model)"""


@query(
    "confusion_metrics",
    f"WITH {SCORED}, {confusion_sql('model', 'score >= 0.5')} SELECT * FROM confusion",
)
def q_confusion(spark, sf):
    rows = scored_labels(spark, sf).withColumn("prediction", ml.decide_class(F.col("score")))
    return rounded(ml.confusion_metrics(rows, ["model"]), 6)


@query("roc_auc", f"WITH {SCORED}, {AUC} SELECT * FROM auc")
def q_auc(spark, sf):
    return rounded(ml.roc_auc(scored_labels(spark, sf), ["model"]), 6)


@query(
    "model_metrics",
    f"""WITH {SCORED}, {confusion_sql('model', 'score >= 0.5')}, {AUC}
    SELECT * FROM confusion JOIN auc USING (model)""",
)
def q_model_metrics(spark, sf):
    rows = scored_labels(spark, sf).withColumn("prediction", ml.decide_class(F.col("score")))
    return rounded(ml.model_metrics(rows), 6)


@query(
    "threshold_sweep",
    f"""WITH {SCORED}, each AS (SELECT *, t AS threshold FROM scored, (VALUES (0.4::DOUBLE), (0.5), (0.6)) v(t)),
    {confusion_sql('threshold', 'score >= threshold', 'each')} SELECT * FROM confusion""",
)
def q_sweep(spark, sf):
    return rounded(ml.threshold_sweep(scored_labels(spark, sf), [0.4, 0.5, 0.6]), 6)


@query(
    "prediction_bands",
    f"""WITH {SCORED} SELECT model, CASE WHEN score > 0.6 THEN 'buy' WHEN score < 0.4 THEN 'sell'
    ELSE 'neutral' END AS band, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS up, count(*)::BIGINT AS n
    FROM scored GROUP BY 1, 2, 3""",
)
def q_bands(spark, sf):
    return scored_labels(spark, sf).groupBy(
        "model", prediction_band(F.col("score")).alias("band"),
        ml.decide_class(F.col("score"), 0.5, inclusive=False).alias("up"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _model_query(train):
    def run(spark, sf):
        data = ind.training_table(stored_bars(spark, sf))
        features = feature_columns(data)
        rows = stage(data.withColumn("row", F.concat_ws("|", "ticker", "date")), "training")
        stored = stage(ml.stratified_split(rows, "target", "row"), "parts")
        fit_rows = stored.filter("part = 'train'")
        scaled = stage(ml.standardize(stored, features, fit_on=fit_rows), "scaled")
        model = train(scaled.filter("part = 'train'"), features)
        tested = ml.score(model, scaled.filter("part = 'test'"), features)
        return ml.confusion_metrics(tested, ["part"], "target").join(
            ml.roc_auc(tested, ["part"], "target"), "part"
        )

    return run


query("model_logistic")(_model_query(ml.train_logistic))
query("model_forest")(_model_query(ml.train_forest))
query("model_perceptron")(_model_query(ml.train_perceptron))


# --- exploration -------------------------------------------------------------------------------
@query(
    "date_range",
    f"WITH {BARS_SQL} SELECT ticker, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY 1",
)
def q_range(spark, sf):
    return ts.date_range(daily_bars(spark, sf))


@query(
    "seasonal_decompose",
    f"""WITH {BARS_SQL}, n AS (SELECT ticker, date, close,
      (row_number() OVER (PARTITION BY ticker ORDER BY date) - 1) % 5 AS phase,
      CASE WHEN count(*) OVER w = 5 THEN avg(close) OVER w END AS trend FROM bars
      WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    p AS (SELECT ticker, phase, avg(close - trend) AS m FROM n GROUP BY 1, 2),
    s AS (SELECT ticker, phase, m - avg(m) OVER (PARTITION BY ticker) AS seasonal FROM p)
    SELECT ticker, date, close, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal,
      round(close - trend - seasonal, 4) AS residual FROM n JOIN s USING (ticker, phase)""",
)
def q_decompose(spark, sf):
    return rounded(ts.seasonal_decompose(stored_bars(spark, sf)))


@query(
    "adf",
    f"""WITH {BARS_SQL}, p AS (SELECT ticker, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS x,
      close AS c FROM bars), d AS (SELECT ticker, x, c - x AS y FROM p WHERE x IS NOT NULL),
    s AS (SELECT ticker, count(*)::BIGINT AS n_obs, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx,
      regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM d GROUP BY ticker)
    SELECT ticker, n_obs, round(b / sqrt((syy - b * sxy) / (n_obs - 2) / sxx), 6) AS adf_statistic,
      b / sqrt((syy - b * sxy) / (n_obs - 2) / sxx) < -2.86154 AS stationary FROM s""",
)
def q_adf(spark, sf):
    out = ts.dickey_fuller(stored_bars(spark, sf))
    return rounded(out.select("ticker", "n_obs", "adf_statistic", "stationary"), 6)


@query("adf_lags")
def q_adf_lags(spark, sf):
    return ts.augmented_dickey_fuller(stored_bars(spark, sf))


@query(
    "adf_fixed_lag",
    f"""WITH {BARS_SQL}, p AS (SELECT ticker, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS x,
      close AS c FROM bars), d AS (SELECT ticker, x, c - x AS y FROM p WHERE x IS NOT NULL),
    s AS (SELECT ticker, count(*)::BIGINT AS n_obs, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx,
      regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM d GROUP BY ticker)
    SELECT ticker, 0 AS lag, n_obs, round(b / sqrt((syy - b * sxy) / (n_obs - 2) / sxx), 6) AS adf_statistic FROM s""",
)
def q_adf_fixed_lag(spark, sf):
    return rounded(ts.augmented_dickey_fuller(stored_bars(spark, sf), lag=0).drop("p_value"), 6)


@query(
    "acf",
    f"""WITH {BARS_SQL}, x AS (SELECT ticker, date, close - avg(close) OVER (PARTITION BY ticker) AS x,
      row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM bars),
    s AS (SELECT a.ticker, l.k AS lag, sum(a.x * b.x) AS p FROM x a, range(0, 31) l(k), x b
      WHERE b.ticker = a.ticker AND b.rn = a.rn - l.k GROUP BY 1, 2)
    SELECT s.ticker, s.lag, round(s.p / z.p, 6) AS acf FROM s JOIN s z ON z.ticker = s.ticker AND z.lag = 0""",
)
def q_acf(spark, sf):
    return rounded(ts.acf(stored_bars(spark, sf)), 6)


@query(
    "pacf",
    f"""WITH RECURSIVE {BARS_SQL}, x AS (SELECT ticker, date, close - avg(close) OVER (PARTITION BY ticker) AS x,
      row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM bars),
    s AS (SELECT a.ticker, l.k AS lag, sum(a.x * b.x) AS p FROM x a, range(0, 31) l(k), x b
      WHERE b.ticker = a.ticker AND b.rn = a.rn - l.k GROUP BY 1, 2),
    r AS (SELECT s.ticker, list(s.p / z.p ORDER BY s.lag) AS r
      FROM s JOIN s z ON z.ticker = s.ticker AND z.lag = 0 GROUP BY 1),
    step AS (
      SELECT ticker, r, 0 AS k, []::DOUBLE[] AS f, 1.0::DOUBLE AS v, 1.0::DOUBLE AS p FROM r
      UNION ALL
      SELECT ticker, r, k + 1,
        list_append(list_transform(range(1, k + 1), lambda j: f[j] - a * f[k + 1 - j]), a), v * (1 - a * a), a
      FROM (SELECT *, (r[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1),
              lambda j: f[j] * r[k + 2 - j])), 0)) / v AS a FROM step WHERE k < 30))
    SELECT ticker, k::BIGINT AS lag, round(p, 6) AS pacf FROM step""",
)
def q_pacf(spark, sf):
    return rounded(ts.pacf(stored_bars(spark, sf)), 6)


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount"]
NUMERIC_LONG = f"""
long AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, {c} AS v FROM lineitem" for c in NUMERIC)})"""


@query(
    "describe",
    f"""WITH {NUMERIC_LONG} SELECT col AS "column", count(*)::BIGINT AS count, round(avg(v), 4) AS mean,
    round(stddev_samp(v), 4) AS std, min(v) AS min, max(v) AS max,
    round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50,
    round(quantile_cont(v, 0.75), 4) AS q75 FROM long GROUP BY col""",
)
def q_describe(spark, sf):
    return rounded(ts.describe(table(spark, sf, "lineitem"), NUMERIC))


@query(
    "histogram",
    f"""WITH {NUMERIC_LONG}, e AS (SELECT col, min(v) AS lo, max(v) AS hi FROM long GROUP BY col)
    SELECT col AS "column", least(floor((v - lo) / (hi - lo) * 20), 19)::BIGINT AS bin,
      round(min(lo + (hi - lo) / 20 * least(floor((v - lo) / (hi - lo) * 20), 19)), 4) AS bin_start,
      count(*)::BIGINT AS n FROM long JOIN e USING (col) GROUP BY 1, 2""",
)
def q_histogram(spark, sf):
    return rounded(ts.histogram(table(spark, sf, "lineitem"), NUMERIC))


@query(
    "iqr_outliers",
    """WITH long AS (SELECT 'value' AS col, value AS v FROM events UNION ALL SELECT 'user_id', user_id FROM events),
    q AS (SELECT col, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50,
          quantile_cont(v, 0.75) AS q75 FROM long GROUP BY col),
    f AS (SELECT *, v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM long JOIN q USING (col))
    SELECT col AS "column", round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75,
      min(CASE WHEN inside THEN v END)::DOUBLE AS whisker_low, max(CASE WHEN inside THEN v END)::DOUBLE AS whisker_high,
      count_if(NOT inside)::BIGINT AS n_outliers FROM f GROUP BY col, q25, q50, q75""",
)
def q_outliers(spark, sf):
    return rounded(ts.iqr_outliers(table(spark, sf, "events"), ["value", "user_id"]))


@query(
    "outlier_rows",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    SELECT event_id, value FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""",
)
def q_outlier_rows(spark, sf):
    return ts.outlier_rows(table(spark, sf, "events"), "value").select("event_id", "value")
