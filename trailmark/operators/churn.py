"""Churn features, splits, models and their metrics."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.columns import BEHAVIORS, half_up, long, one_row, ratio
from trailmark.operators.ranking import interpolated_quantiles, running_sums, with_row_number
from trailmark.session import shared_dir

OBS_END, PRED_END = "2024-01-29", "2024-01-30"

FEATURES = [
    *[f"total_{b}" for b in BEHAVIORS],
    "active_days",
    "active_hours",
    "recency_days",
    "weekend_ratio",
    "buy_conversion",
    "cart_conversion",
    "fav_conversion",
]


def _window_features(ub: DataFrame, inside, end) -> DataFrame:
    """One row per user over the rows where ``inside`` holds, plus ``has_later``.

    Distinct hours are a 24-bit mask, so only the dates need a distinct count.
    """
    later = ~inside
    return (
        ub.groupBy("user_id")
        .agg(
            *[
                F.count_if(inside & (F.col("behavior_type") == b)).alias(f"total_{b}")
                for b in BEHAVIORS
            ],
            F.count_if(inside).alias("events"),
            F.count_distinct(F.when(inside, F.col("date"))).alias("active_days"),
            F.bit_or(
                F.when(inside, F.expr("shiftleft(1, hour)")).otherwise(0)
            ).alias("hour_mask"),
            F.max(F.when(inside, F.col("date"))).alias("last_date"),
            F.sum(F.when(inside, F.col("is_weekend")).otherwise(0)).alias("weekend_events"),
            F.max(later.cast("int")).alias("has_later"),
        )
        .filter(F.col("events") > 0)
        .select(
            "user_id",
            *[f"total_{b}" for b in BEHAVIORS],
            "active_days",
            long(F.bit_count("hour_mask")).alias("active_hours"),
            "last_date",
            long(F.datediff(end, "last_date")).alias("recency_days"),
            ratio("weekend_events", "events", 6).alias("weekend_ratio"),
            *[
                half_up(F.col(f"total_{b}") / (F.col("total_pv") + 0.001), 6).alias(f"{b}_conversion")
                for b in ("buy", "cart", "fav")
            ],
            "has_later",
        )
    )


def churn_features(ub: DataFrame, obs_end: str = OBS_END, pred_end: str = PRED_END) -> DataFrame:
    """Features up to ``obs_end``; churn is no event in (obs_end, pred_end]. One pass for both."""
    end = F.lit(obs_end).cast("date")
    rows = ub.filter(F.col("date") <= F.lit(pred_end).cast("date"))
    out = _window_features(rows, F.col("date") <= end, end)
    return out.withColumn("churn", long(1 - F.col("has_later"))).drop("has_later")


def churn_label_lastk(ub: DataFrame, k: int = 2) -> DataFrame:
    """Features over the whole window, churn is a last date more than ``k`` days before its end."""
    latest = one_row(ub.agg(F.max("date").alias("d")))("d")
    out = _window_features(ub, F.col("date").isNotNull(), latest).drop("has_later")
    return out.withColumn("churn", long(F.col("recency_days") > k))


def churn_sample(features: DataFrame, cap: int | None = None, seed: int = 42) -> DataFrame:
    """A seeded sample of at most ``cap`` users in hash order; None keeps all."""
    if cap is None:
        return features
    return features.orderBy(F.xxhash64("user_id", F.lit(seed)), "user_id").limit(cap)


def time_split(features: DataFrame, test_share: float = 0.2) -> DataFrame:
    """Adds ``is_test``: the users active last.

    The cut is the quantile of the last date; where many users share that date and the test part
    comes out at less than half or more than twice its share, the last rows by (date, user) are
    taken instead.
    """
    days = features.withColumn("_day", long(F.unix_date("last_date")))
    cut_day = interpolated_quantiles(days, "_day", [1 - test_share]).first()["q0"]
    is_test = F.col("_day") >= F.lit(cut_day)
    got = days.agg(F.count("*").alias("n"), F.count_if(is_test).alias("t")).first()
    n, share = got["n"], got["t"] / max(got["n"], 1)
    if test_share * 0.5 <= share <= test_share * 2:
        return days.withColumn("is_test", is_test).drop("_day")
    n_test = int(n * test_share)
    numbered = with_row_number(days, [F.asc("_day"), F.asc("user_id")], "_no")
    return numbered.withColumn("is_test", F.col("_no") > n - n_test).drop("_day", "_no")


def stratified_split(features: DataFrame, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test`` from a hash of label and user: the same share of every label."""
    bucket = F.pmod(F.xxhash64("churn", "user_id", F.lit(seed)), F.lit(10_000))
    return features.withColumn("is_test", bucket < int(test_share * 10_000))


def split_summary(split: DataFrame) -> DataFrame:
    return split.groupBy(long("is_test").alias("is_test")).agg(
        F.count("*").alias("users"),
        F.sum("churn").alias("churned"),
        F.min("last_date").alias("min_last_date"),
        F.max("last_date").alias("max_last_date"),
    )


# --- models ----------------------------------------------------------------------------------------


def fit_lr(train: DataFrame, max_iter: int = 1000):
    """Standardised features and logistic regression."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=FEATURES, outputCol="raw_features", handleInvalid="keep"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
            LogisticRegression(labelCol="churn", featuresCol="features", maxIter=max_iter),
        ]
    ).fit(train)


def fit_gbt(train: DataFrame, trees: int = 200, depth: int = 5, seed: int = 42):
    """Gradient-boosted trees with row and column subsampling; lineage is cut as trees are added."""
    shared_dir(train.sparkSession)
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep"),
            GBTClassifier(
                labelCol="churn",
                featuresCol="features",
                maxIter=trees,
                maxDepth=depth,
                stepSize=0.1,
                subsamplingRate=0.8,
                featureSubsetStrategy="0.8",
                checkpointInterval=10,
                seed=seed,
            ),
        ]
    ).fit(train)


def score(model, test: DataFrame) -> DataFrame:
    """(user_id, label, score, predicted) of a fitted pipeline."""
    return model.transform(test).select(
        "user_id",
        F.col("churn").alias("label"),
        vector_to_array("probability")[1].alias("score"),
        long("prediction").alias("predicted"),
    )


def feature_importance(model) -> DataFrame:
    """Features by importance; one row per feature."""
    spark = SparkSession.getActiveSession()
    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(FEATURES, (float(v) for v in values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


# --- metrics ----------------------------------------------------------------------------------------


def roc_points(pred: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, highest first.

    Scores are grouped first; the running totals use an even range partitioning of the scores, so
    they hold for as many distinct scores as there are users.
    """
    groups = pred.groupBy("score").agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")
    )
    summed = running_sums(groups, [F.desc("score")], {"tp": "pos", "fp": "neg"})
    total = one_row(pred.agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")))
    return summed.select(
        F.col("score").alias("threshold"),
        ratio("fp", total("n"), 6).alias("fpr"),
        ratio("tp", total("p"), 6).alias("tpr"),
        "tp",
        "fp",
        "pos",
        "neg",
    )


def classification_metrics(pred: DataFrame) -> DataFrame:
    """AUC, accuracy, precision, recall and F1 of (label, score, predicted); one row."""
    curve = roc_points(pred).agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area"),
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
    )
    auc = one_row(
        curve.select(ratio("area", F.col("p").cast("double") * F.col("n"), 6).alias("auc"))
    )("auc")
    hit = F.col("label") == 1
    yes = F.col("predicted") == 1
    one = pred.agg(
        F.count("*").alias("n"),
        F.count_if(hit & yes).alias("tp"),
        F.count_if(~hit & yes).alias("fp"),
        F.count_if(hit & ~yes).alias("fn"),
        F.count_if(~hit & ~yes).alias("tn"),
    )
    zero = F.lit(0.0)
    return one.select(
        auc.alias("auc"),
        ratio(F.col("tp") + F.col("tn"), "n", 6).alias("accuracy"),
        F.coalesce(ratio("tp", F.col("tp") + F.col("fp"), 6), zero).alias("precision"),
        F.coalesce(ratio("tp", F.col("tp") + F.col("fn"), 6), zero).alias("recall"),
        F.coalesce(
            ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), 6), zero
        ).alias("f1"),
    )
