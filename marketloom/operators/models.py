"""Scaling, splits, Spark ML baselines and classification metrics."""

from __future__ import annotations


from pyspark.ml import Model
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.ordering import rank_cuts, running_totals
from marketloom.operators.series import STRETCH, TIME_LEVELS, with_time_levels

# Parameters of the baselines.
SEED = 42
TEST_SHARE = 0.2
MAX_ITER = 1000
TREES, DEPTH = 100, 10
HIDDEN, EPOCHS = [128, 64, 32], 50


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with mean and population deviation per column, ``mean_x`` and ``std_x``.

    A deviation of zero becomes 1.
    """
    def deviation(c: str) -> Column:
        std = F.stddev_pop(c)
        return F.when(std == 0, F.lit(1.0)).otherwise(std).alias(f"std_{c}")

    return df.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns], *[deviation(c) for c in columns])


def standardize(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Columns centred and scaled by the statistics of ``fit_on`` (all rows by default)."""
    fit = fit_scaler(df if fit_on is None else fit_on, columns).select(F.struct("*")).scalar()
    return df.withColumns(
        {c: (F.col(c) - fit[f"mean_{c}"]) / fit[f"std_{c}"] for c in columns}
    )


def stratified_split(
    df: DataFrame, target: str, key: str, seed: int = SEED, share: float = TEST_SHARE
) -> DataFrame:
    """Add ``part``: test, validation or train, with exact shares inside each class.

    Rows of a class are ordered by the md5 of key and seed; the first ``ceil(share * n)`` are the
    test set, then ``ceil(share * rest)`` the validation set. ``key`` must be unique. The two cut
    points per class are found by counts over prefixes of the hash, so no class is sorted.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))))
    rows = hashed.withColumns({"_h3": F.substring("_hash", 1, 3), "_h6": F.substring("_hash", 1, 6)})
    levels = ["_h3", "_h6", "_hash"]
    sizes = rows.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    test = F.ceil(F.col("_n") * share)
    both = test + F.ceil((F.col("_n") - test) * share)
    ranks = sizes.select(
        target,
        F.inline(
            F.array(
                F.struct(F.lit("test").alias("cut"), test.alias("k")),
                F.struct(F.lit("validation").alias("cut"), both.alias("k")),
            )
        ),
    )
    cuts = rank_cuts(rows, [target], levels, ranks)
    # two hashes per class; a class without a cut row lies before it as a whole
    ends = cuts.groupBy(target).agg(
        F.max(F.when(F.col("cut") == "test", F.col("_hash"))).alias("_test_end"),
        F.max(F.when(F.col("cut") == "validation", F.col("_hash"))).alias("_validation_end"),
    )
    part = (
        F.when(F.coalesce(F.col("_hash") < F.col("_test_end"), F.lit(True)), "test")
        .when(F.coalesce(F.col("_hash") < F.col("_validation_end"), F.lit(True)), "validation")
        .otherwise("train")
    )
    joined = rows.join(ends, target, "left")
    return joined.withColumn("part", part).select(*df.columns, "part")


def time_split(df: DataFrame, order: str = "date", shares: tuple = (0.6, 0.2)) -> DataFrame:
    """Add ``part`` by time: train, validation, test in the order of ``order``.

    The cut dates are those of the rows at the two ranks; all rows of a date stay together.
    """
    rows = with_time_levels(df.select(order), order).withColumn("_all", F.lit(0))
    n = F.count(F.lit(1))
    ranks = rows.agg(
        F.array(
            F.struct(F.lit("train").alias("cut"), F.floor(n * shares[0]).alias("k")),
            F.struct(F.lit("validation").alias("cut"), F.floor(n * sum(shares)).alias("k")),
        ).alias("_cuts")
    ).select(F.lit(0).alias("_all"), F.inline("_cuts"))
    cuts = rank_cuts(rows, ["_all"], [STRETCH, *TIME_LEVELS, order], ranks)
    ends = cuts.agg(
        F.struct(
            F.max(F.when(F.col("cut") == "train", F.col(order))).alias("train"),
            F.max(F.when(F.col("cut") == "validation", F.col(order))).alias("validation"),
        )
    ).scalar()
    part = (
        F.when(F.col(order) < ends["train"], "train")
        .when(F.col(order) < ends["validation"], "validation")
        .otherwise("test")
    )
    return df.withColumn("part", part)


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def train_logistic(train: DataFrame, features: list[str], label: str = "target") -> Model:
    """L2 logistic regression with penalty 1/n, on columns that are already standardised."""
    n = train.count()
    model = LogisticRegression(
        labelCol=label, maxIter=MAX_ITER, regParam=1 / max(n, 1), standardization=False
    )
    return model.fit(_assembled(train, features))


def train_forest(
    train: DataFrame, features: list[str], label: str = "target", trees: int = TREES
) -> Model:
    model = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=DEPTH, seed=SEED)
    return model.fit(_assembled(train, features))


def train_perceptron(
    train: DataFrame, features: list[str], label: str = "target", epochs: int = EPOCHS
) -> Model:
    """Feed-forward net with hidden layers 128, 64, 32; sigmoid hidden units, softmax output."""
    model = MultilayerPerceptronClassifier(
        labelCol=label, layers=[len(features), *HIDDEN, 2], maxIter=epochs, seed=SEED
    )
    return model.fit(_assembled(train, features))


def score(model: Model, df: DataFrame, features: list[str], inclusive: bool = True) -> DataFrame:
    """Add ``score`` (probability of class 1) and ``prediction``.

    The class is 1 at a score of 0.5 when ``inclusive`` (evaluation), else only above (serving).
    """
    scored = model.transform(_assembled(df, features)).withColumn(
        "score", vector_to_array("probability")[1]
    )
    return scored.drop("features", "rawPrediction", "probability", "prediction").withColumn(
        "prediction", decide_class(F.col("score"), 0.5, inclusive)
    )


def decide_class(value: Column, threshold: float | Column = 0.5, inclusive: bool = True) -> Column:
    positive = value >= threshold if inclusive else value > threshold
    return positive.cast("int")


def _rate(hits: Column, base: Column) -> Column:
    return F.coalesce(F.try_divide(hits, base), F.lit(0.0))


def confusion_metrics(
    df: DataFrame, group: list[str], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 per group; 0 where a ratio has no base."""
    y, p = F.col(label), F.col(prediction)
    counts = df.groupBy(*group).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "accuracy": _rate(tp + tn, tp + fp + fn + tn),
            "precision": _rate(tp, tp + fp),
            "recall": _rate(tp, tp + fn),
            "f1": _rate(2 * tp, 2 * tp + fp + fn),
        }
    )


def roc_auc(
    df: DataFrame, group: list[str], label: str = "label", score_column: str = "score"
) -> DataFrame:
    """Area under the ROC curve per group: rank sum with ties counted half.

    Rows are counted per score first; ranks come from running totals over the scores. Null when a
    group has only one class.
    """
    counts = df.groupBy(*group, score_column).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    totals = running_totals(counts, group, score_column, ["pos", "neg"])
    won = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)
    return totals.groupBy(*group).agg(
        F.try_divide(F.sum(won), F.max(F.col("total_pos").cast("double") * F.col("total_neg"))).alias(
            "roc_auc"
        )
    )


def model_metrics(df: DataFrame, group: list[str] = ["model"], label: str = "label") -> DataFrame:
    """Confusion metrics and ROC-AUC side by side per model."""
    return confusion_metrics(df, group, label).join(roc_auc(df, group, label), group, "left")


def threshold_sweep(
    df: DataFrame, thresholds: list[float], label: str = "label", score_column: str = "score"
) -> DataFrame:
    """Confusion metrics at each threshold; each row is tested against all of them in one pass."""
    each = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    classed = each.withColumn("prediction", decide_class(F.col(score_column), F.col("threshold")))
    return confusion_metrics(classed, ["threshold"], label)
