"""Quality rules: text statistics and robust multivariate outliers per language and source."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement as pairs_of

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import SPACES, let, shingles, total, whole, words
from marketloom.session import stage

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

# Transformed statistics, and the least deviation assumed for each: spread below it says nothing
# about quality. It also keeps covariances regular where a statistic is constant.
FEATURES = ["log_word_length", "symbol_angle", "line_angle", "repeat_angle"]
LEAST_DEVIATION = [0.1, 0.05, 0.25, 0.15]
GRID = 256  # transformed statistics are whole multiples of 1 / GRID, so that sums are exact
CORE_SHARE = 0.6  # share of each group that the determinant is minimised over
INSIDE = 0.975  # reweighting: rows within this probability form the final estimate
# Rows beyond this tail probability are rejected: 4.85 deviations, so that with the least deviations
# above each statistic can reject alone (repeated lines at most 1.57 away, repeated words 0.79).
OUTSIDE = 1e-4
SHRINK = 20  # a group's estimate counts as its rows, its language's as so many rows
FALL = 1e-3  # a step counts while it lowers the determinant of its group by more than this share
MAX_STEPS = 100


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and the counts n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words of the whole text.

    Null text has no word and no line. Missing ``lang`` or ``source`` columns count as null.
    Repeated three-word windows are told by 64-bit hashes inside one document.
    """
    body = whole(text)
    blank = F.length(F.translate(F.col("_text"), BLANKS, ""))
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    group = [
        (F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c)
        for c in ("lang", "source")
    ]
    rows = docs.select(F.col(doc_id).alias("doc_id"), *group, body.alias("_text"))
    counted = let(
        words(F.col("_text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")
        ),
    )
    line_counts = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return rows.select(
        "doc_id", "lang", "source",
        blank.cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate(F.col("_text"), SYMBOLS, "")))
        .cast("long").alias("n_symbols"),
        counted.alias("_w"), line_counts.alias("_l"),
    ).select("doc_id", "lang", "source", "word_chars", "n_symbols", "_w.*", "_l.*")


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""

    def of(hashes: Column) -> Column:
        placed = F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(placed, _covered)
        )

    return let(shingles(w, 3), of).cast("long")


def _covered(placed: Column) -> Column:
    twins = F.filter(
        placed,
        lambda x, i: F.coalesce(F.get(placed, i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(placed, i + 1)["h"] == x["h"], F.lit(False)),
    )
    starts = F.sort_array(F.transform(twins, lambda x: x["p"]))
    return let(
        starts,
        lambda s: total(
            F.transform(
                s, lambda p, i: F.least(F.coalesce(F.get(s, i + 1) - p, F.lit(3)), F.lit(3))
            )
        ),
    )


def quality_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    core_share: float = CORE_SHARE, outside: float = OUTSIDE,
) -> DataFrame:
    """One row per row of ``docs``: statistics, base_failed, distance, kept.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows.
    The others are judged by the minimum covariance determinant: statistics are transformed (log of
    the mean word length, arcsine of the square root of the shares of symbols, repeated lines and
    repeated words); per (lang, source), and per lang over all its sources, concentration steps go
    to the ``core_share`` of rows with least distance while the determinant falls by ``FALL``. They start
    from the medians and from the moments of all rows; of the two ends the one of smaller determinant
    counts. A reweighting step follows. The estimate of a source is then drawn towards that of its
    language, as if ``SHRINK`` rows of the language were added to it; a source whose centre itself
    lies outside of the inner part of its language is judged by the language's estimate alone. So a
    source of few rows, or of junk only, does not set its own norm.
    ``kept`` is false where the squared Mahalanobis distance exceeds the chi-square quantile of
    ``1 - outside``. All rows enter: equal vectors are counted once with their number, so the steps
    run over few vectors per group, and all sums are whole numbers, the same in any order.

    Null or empty text, or a text without words, fails the base rule. A group of one row, of equal
    rows, or with a null language or source is judged like any other (nulls form a group). An empty
    table gives no rows. Repeated rows give repeated results.
    """
    stats = stage(_with_vector(text_statistics(docs, doc_id, text)), "text_statistics")
    group = ["lang", "source"]
    vectors = stage(
        stats.filter(~F.col("base_failed"))
        .groupBy(*group, *FEATURES).agg(F.count(F.lit(1)).alias("n")),
        "vectors",
    )
    estimate = _estimate(vectors, group, core_share)
    judged = _joined(stats, estimate, group)
    limit = chi2_quantile(1 - outside, len(FEATURES))
    inside = F.coalesce(F.col("distance") <= limit, F.lit(True))
    return judged.select(
        "doc_id", *group, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", F.when(~F.col("base_failed"), F.col("distance")).alias("distance"),
        (~F.col("base_failed") & inside).alias("kept"),
    )


def _with_vector(stats: DataFrame) -> DataFrame:
    def angle(part: Column, of: Column) -> Column:
        share = part / F.greatest(of, F.lit(1))
        return F.asin(F.sqrt(F.least(share, F.lit(1.0))))

    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    values = [
        F.log(F.greatest(mean, F.lit(1.0))),
        angle(F.col("n_symbols"), F.col("word_chars")),
        angle(F.col("n_dup_lines"), F.col("n_lines")),
        angle(F.col("n_repeat_words"), F.col("n_words")),
    ]
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    )
    return stats.withColumn("base_failed", failed).withColumns(
        {f: F.round(v * GRID).cast("long") for f, v in zip(FEATURES, values)}
    )


def _estimate(vectors: DataFrame, group: list[str], core_share: float) -> DataFrame:
    """Centre and inverse Cholesky factor per group of (lang, source)."""
    copies = F.explode(
        F.array(*[
            F.struct(
                F.lit(level).alias("level"), F.lit(start).alias("start"),
                (F.col("source") if level == "source" else F.lit(None).cast("string")).alias("of"),
            )
            for level in ("source", "lang") for start in ("medians", "all")
        ])
    )
    rows = vectors.select("lang", copies.alias("c"), *FEATURES, "n").select(
        "lang", "c.*", *FEATURES, "n"
    )
    group_of, keys = ["lang", "of", "level"], ["lang", "of", "level", "start"]
    params = _concentrated(rows, keys, core_share)
    best = params.groupBy(*group_of).agg(
        F.min_by(F.struct(*[c for c in params.columns if c not in group_of]), F.struct("det", "start"))
        .alias("p")
    ).select(*group_of, "p.*")
    near = F.col("distance") <= chi2_quantile(INSIDE, len(FEATURES))
    ours = rows.filter(F.col("start") == "all").drop("start")
    inner = _joined(ours, best, group_of).filter(near)
    weighted = stage(_moments(_sums(inner, group_of), group_of, INSIDE), "mcd")
    return stage(_factors(_shrunk(weighted, group)), "mcd")


def _concentrated(rows: DataFrame, keys: list[str], core_share: float) -> DataFrame:
    """Concentration steps per group of ``keys`` until no determinant gets smaller."""
    first = rows.filter(F.col("start") == "medians").groupBy(*keys).agg(
        F.sum("n").alias("size"),
        *[F.percentile(f, 0.5, F.col("n")).alias(f"m_{f}") for f in FEATURES],
    ).withColumns({f"s_{a}_{b}": F.lit(0.0) for a, b in pairs_of(FEATURES, 2)})
    second = _moments(_sums(rows.filter(F.col("start") == "all"), keys), keys, INSIDE)
    params = _factors(first.unionByName(second)).withColumn("det", F.lit(float("inf")))
    params = stage(params.withColumn("moving", F.lit(True)), "mcd")
    for _ in range(MAX_STEPS):
        stepped = _with_determinant(
            _factors(_moments(_core(rows, params, keys, core_share), keys, core_share))
        ).withColumn("moving", F.lit(True))
        same = _all([F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in keys])
        lower = F.col("new.det") < F.col("old.det") * (1 - FALL)
        params = stage(
            params.alias("old").join(stepped.alias("new"), same, "left").select(
                *[F.col(f"old.{c}") for c in keys],
                *[
                    F.when(lower, F.col(f"new.{c}"))
                    .otherwise(F.lit(False) if c == "moving" else F.col(f"old.{c}")).alias(c)
                    for c in params.columns if c not in keys
                ],
            ),
            "mcd",
        )
        if params.filter("moving").isEmpty():
            return params
    raise RuntimeError(f"a group has not settled after {MAX_STEPS} concentration steps")


def _with_determinant(factors: DataFrame) -> DataFrame:
    det = F.lit(1.0)
    for i in range(len(FEATURES)):
        det = det / (F.col(f"r_{i}_{i}") * F.col(f"r_{i}_{i}"))
    return factors.withColumn("det", det)


def _shrunk(moments: DataFrame, group: list[str]) -> DataFrame:
    """Moments per (lang, source), drawn towards those of the language."""
    values = [f"m_{f}" for f in FEATURES] + [f"s_{a}_{b}" for a, b in pairs_of(FEATURES, 2)]
    pooled = moments.filter(F.col("level") == "lang").select("lang", "of", "level", *values)
    sources = moments.filter(F.col("level") == "source").withColumnRenamed("of", "source")
    centres = sources.select(
        *group, "size", *values, F.lit("lang").alias("level"), F.lit(None).cast("string").alias("of"),
        *[F.col(f"m_{f}").alias(f) for f in FEATURES],
    )
    away = _joined(centres, _factors(pooled), ["lang", "of", "level"])
    same = F.col("own.lang").eqNullSafe(F.col("pooled.lang"))
    own = F.when(
        F.col("own.distance") <= chi2_quantile(INSIDE, len(FEATURES)),
        F.col("own.size") / (F.col("own.size") + SHRINK),
    ).otherwise(0.0)
    return away.alias("own").join(pooled.alias("pooled"), same).select(
        *[F.col(f"own.{c}") for c in group], F.col("own.size").alias("size"),
        *[
            (F.col(f"pooled.{v}") + own * (F.col(f"own.{v}") - F.col(f"pooled.{v}"))).alias(v)
            for v in values
        ],
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _sums(rows: DataFrame, group: list[str]) -> DataFrame:
    n = F.col("n")
    return rows.groupBy(*group).agg(
        F.sum(n).alias("size"),
        *[F.sum(n * F.col(f)).alias(f"t_{f}") for f in FEATURES],
        *[F.sum(n * F.col(a) * F.col(b)).alias(f"q_{a}_{b}") for a, b in pairs_of(FEATURES, 2)],
    )


def _core(vectors: DataFrame, params: DataFrame, group: list[str], share: float) -> DataFrame:
    """Sums over the rows of least distance, at least ``share`` of each group.

    Rows are counted by fine steps of the distance; whole steps enter, so ties enter together.
    """
    step = F.floor(F.log2(F.col("distance") + 1.0 / 1024) * 64).alias("step")
    sums = [f"t_{f}" for f in FEATURES] + [f"q_{a}_{b}" for a, b in pairs_of(FEATURES, 2)]
    by_step = _sums(_joined(vectors, params, group).select("*", step), [*group, "step"])
    below = Window.partitionBy(*group).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    run = by_step.select(
        *group, "step",
        *[F.sum(c).over(below).alias(c) for c in ["size", *sums]],
        F.sum("size").over(Window.partitionBy(*group)).alias("_all"),
    )
    enough = run.filter(F.col("size") >= F.col("_all") * share)
    return enough.groupBy(*group).agg(
        *[F.min_by(c, "step").alias(c) for c in ["size", *sums]]
    )


def _moments(sums: DataFrame, group: list[str], share: float) -> DataFrame:
    """Means, and covariances corrected for the share of the distribution they are taken from."""
    p = len(FEATURES)
    factor = share / chi2_cdf(chi2_quantile(share, p), p + 2)
    size = F.col("size").cast("double")
    mean = {f: F.col(f"t_{f}") / size for f in FEATURES}
    return sums.select(
        *group, "size",
        *[mean[f].alias(f"m_{f}") for f in FEATURES],
        *[
            ((F.col(f"q_{a}_{b}") / size - mean[a] * mean[b]) * factor).alias(f"s_{a}_{b}")
            for a, b in pairs_of(FEATURES, 2)
        ],
    )


def _factors(moments: DataFrame) -> DataFrame:
    """Add the inverse of the lower Cholesky factor, ``r_i_j``, of covariance plus least variance."""
    p = range(len(FEATURES))

    def cell(i: int, j: int) -> Column:
        value = F.col(f"s_{FEATURES[j]}_{FEATURES[i]}")
        return value + (LEAST_DEVIATION[i] * GRID) ** 2 if i == j else value

    def rest(i: int, j: int) -> Column:
        value = cell(i, j)
        for k in range(j):
            value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        return value

    def inverse(i: int, j: int) -> Column:
        if i == j:
            return 1 / F.col(f"l_{i}_{i}")
        value = F.lit(0.0)
        for k in range(j, i):
            value = value - F.col(f"l_{i}_{k}") * F.col(f"r_{k}_{j}")
        return value / F.col(f"l_{i}_{i}")

    out = moments
    for j in p:  # one projection per column of the factor, and per row of its inverse
        root = F.sqrt(rest(j, j))
        below = {f"l_{i}_{j}": rest(i, j) / root for i in range(j + 1, len(FEATURES))}
        out = out.withColumns({f"l_{j}_{j}": root, **below})
    for i in p:
        out = out.withColumns({f"r_{i}_{j}": inverse(i, j) for j in range(i + 1)})
    return out.drop(*[f"l_{i}_{j}" for j in p for i in range(j, len(FEATURES))])


def _joined(rows: DataFrame, params: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with the squared ``distance`` to the centre of their group (null: no estimate)."""
    keep = [F.col(f"rows.{c}") for c in rows.columns]
    same = _all([F.col(f"rows.{c}").eqNullSafe(F.col(f"params.{c}")) for c in group])
    both = rows.alias("rows").join(params.alias("params"), same, "left")
    away = [F.col(f"rows.{f}") - F.col(f"params.m_{f}") for f in FEATURES]
    distance = F.lit(0.0)
    for i in range(len(FEATURES)):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(f"params.r_{i}_{j}") * away[j]
        distance = distance + part * part
    return both.select(*keep, distance.alias("distance"))


def chi2_cdf(x: float, dof: int) -> float:
    """Chi-square distribution for an even number of degrees of freedom."""
    half, term, sums = x / 2, 1.0, 0.0
    for k in range(dof // 2):
        sums += term
        term *= half / (k + 1)
    return 1 - math.exp(-half) * sums


def chi2_quantile(prob: float, dof: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, dof) < prob:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, dof) < prob else (low, middle)
    return high


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that the quality rules reject; all columns stay.

    Rows without an id are judged too, by their text: the verdict is joined on id and text hash.
    """
    named = docs.select(
        F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash")).alias("key"),
        F.col(text).alias("text"),
        *[F.col(c) for c in ("lang", "source") if c in docs.columns],
    )
    rejected = quality_rules(named, "key", "text").filter(~F.col("kept"))
    ids = rejected.select(
        F.col("doc_id.id").alias("id"), F.col("doc_id.hash").alias("hash")
    ).distinct().alias("bad")
    same = F.col(f"rows.{doc_id}").eqNullSafe(F.col("bad.id")) & (
        F.xxhash64(F.col(f"rows.{text}")) == F.col("bad.hash")
    )
    return docs.alias("rows").join(ids, same, "left_anti")
