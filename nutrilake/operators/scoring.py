"""Classifier scoring (A5-A7): confusion matrix, per-class scores and overall
scores with Cohen's kappa.

Everything is derived from one grouped count of (actual, predicted) pairs,
whose size is bounded by classes^2 whatever the input size; rows where
either side is missing are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return (df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
            .groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """A5: one row per actual value, one count column per predicted class."""
    pairs = pair_counts(df, actual, predicted)
    return (pairs.groupBy("actual")
            .agg(*[F.sum(F.when(F.col("predicted") == c, F.col("n")).otherwise(0)).alias(c) for c in classes]))


def class_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """TP, FP, TN, FN, recall, precision, sensitivity, specificity and
    F-measure for every value seen on either side."""
    pairs = pair_counts(df, actual, predicted)
    # each pair contributes TP to its class, or FP to the predicted class and
    # FN to the actual class: a generator, no join between classes and pairs
    contrib = pairs.select(F.inline(F.when(
        F.col("actual") == F.col("predicted"),
        F.array(F.struct(F.col("actual").alias("cls"), F.col("n").alias("tp"), F.lit(0).cast("bigint").alias("fp"),
                         F.lit(0).cast("bigint").alias("fn"))),
    ).otherwise(F.array(
        F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("fp"),
                 F.lit(0).cast("bigint").alias("fn")),
        F.struct(F.col("actual").alias("cls"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"),
                 F.col("n").alias("fn")),
    ))))
    total = pairs.select(F.sum("n")).scalar()
    per = contrib.groupBy("cls").agg(F.sum("tp").alias("TP"), F.sum("fp").alias("FP"), F.sum("fn").alias("FN"))
    tp, fp, fn = F.col("TP"), F.col("FP"), F.col("FN")
    tn = total - tp - fp - fn
    recall = F.try_divide(tp.cast("double"), (tp + fn).cast("double"))
    precision = F.try_divide(tp.cast("double"), (tp + fp).cast("double"))
    specificity = F.try_divide(tn.cast("double"), (tn + fp).cast("double"))
    f_measure = F.try_divide(2.0 * precision * recall, precision + recall)
    return per.select(
        F.col("cls").alias("class"), tp.alias("TP"), fp.alias("FP"), tn.alias("TN"), fn.alias("FN"),
        recall.alias("recall"), precision.alias("precision"), recall.alias("sensitivity"),
        specificity.alias("specificity"), f_measure.alias("f_measure"))


def overall_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy, error, #correct, #false and Cohen's kappa in one row."""
    per = class_scores(df, actual, predicted)
    agg = per.agg(
        F.sum("TP").alias("n_correct"),
        F.sum("FN").alias("n_false"),
        F.sum((F.col("TP") + F.col("FN")) * (F.col("TP") + F.col("FP"))).alias("marg"),
    )
    n = (F.col("n_correct") + F.col("n_false")).cast("double")
    po = F.col("n_correct") / n
    pe = F.col("marg") / (n * n)
    return agg.select(
        po.alias("accuracy"),
        (F.col("n_false") / n).alias("error"),
        F.col("n_correct"), F.col("n_false"),
        F.try_divide(po - pe, 1.0 - pe).alias("cohen_kappa"),
    )
