"""Grade model on the product table.

Label: the scan-scoring grade (F12) of each product, lower-cased, so the
label is learnable from the nutrients. Features: seven nutrients - the six
of the reference's seven that the product table has, with energy in place
of the absent carbohydrates column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nutrilake.functions import nutrition as N
from nutrilake.functions.rules import ok_diff
from nutrilake.operators import forest, gainforest, sampling, scoring
from nutrilake.plans.vectors import index_folder
from nutrilake.session import materialize
from nutrilake.sources import staged, tables

FEATURES = ["fat_100g", "saturated_fat_100g", "energy_100g", "sugars_100g", "fiber_100g", "proteins_100g",
            "salt_100g"]
LABEL = "nutrition_grade_fr"
NUM_TREES = 100
FOLDS = 5


def model_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.products(spark, sf_dir)
    nut = F.create_map(*sum([[F.lit(key), F.col(c)] for key, c in tables.NUTRIMENT_KEYS], []))
    return N.add_scan_score(p, nut).select("row_id", *FEATURES, F.lower("_s_nutriscore_predit").alias(LABEL))


def _scored(pred: DataFrame) -> DataFrame:
    return pred.withColumn("comparaison_nutri", ok_diff(F.col(LABEL), F.col("prediction"))).select(
        "row_id", LABEL, "prediction", "confidence", "comparaison_nutri")


def _fit(spark, sf_dir):
    """(model, training rows, held-out rows) of the 80/20 split. The model is fitted once for the present files of the tables and
    saved in the shared folder; the other queries load it."""
    data = materialize(sampling.split_relative(model_input(spark, sf_dir), "row_id", 0.8))
    train = data.where(F.col("partition") == "train").drop("partition")
    test = data.where(F.col("partition") == "test").drop("partition")
    path = index_folder(spark, sf_dir, f"forest-tables-{NUM_TREES}", ("part", "nation"))
    staged.recover(spark, path)
    if not staged.exists(spark, path):
        model = forest.fit_forest(train, FEATURES, LABEL, num_trees=NUM_TREES)
        staged.replace(spark, path, model.save)
    return forest.ForestModel.load(spark, path), train, test


def forest_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _, test = _fit(spark, sf_dir)
    return _scored(forest.predict(model, test, FEATURES, LABEL))


def forest_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4 + A5: confusion matrix of the holdout predictions."""
    return scoring.confusion_matrix(forest_holdout(spark, sf_dir), LABEL, "prediction", "abcde")


def forest_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4 + A6: scores of each class on the holdout."""
    return scoring.class_scores(forest_holdout(spark, sf_dir), LABEL, "prediction")


def forest_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4, Q5 + A7: accuracy, error, counts and kappa on the holdout and on the full table."""
    model, _, test = _fit(spark, sf_dir)
    parts = [scoring.overall_scores(_scored(forest.predict(model, rows, FEATURES, LABEL)), LABEL, "prediction")
             .withColumn("rows", F.lit(name)) for name, rows in (("holdout", test), ("full", model_input(spark, sf_dir)))]
    return parts[0].unionByName(parts[1])


def forest_ok_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4 + A1: OK and DIFF rows of the holdout."""
    return forest_holdout(spark, sf_dir).groupBy("comparaison_nutri").agg(F.count(F.lit(1)).alias("n"))


def forest_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _, _ = _fit(spark, sf_dir)
    return _scored(forest.predict(model, model_input(spark, sf_dir), FEATURES, LABEL))


def forest_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: importance of each model feature."""
    return forest.feature_importances(spark, _fit(spark, sf_dir)[0], FEATURES)


def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 re-aimed: k-fold out-of-fold predictions (fold = first 7 hex digits of md5(row_id) mod k)."""
    data = materialize(model_input(spark, sf_dir)
                       .withColumn("fold", F.pmod(F.conv(F.substring(F.md5(F.col("row_id").cast("string")), 1, 7), 16, 10).cast("int"), F.lit(FOLDS))))
    parts = []
    for f in range(FOLDS):
        model = forest.fit_forest(data.where(F.col("fold") != f), FEATURES, LABEL, num_trees=NUM_TREES)
        pred = forest.predict(model, data.where(F.col("fold") == f), FEATURES, LABEL)
        parts.append(pred.select("row_id", "fold", LABEL, "prediction", "confidence",
                                 *[F.col(f"p_{g}") if f"p_{g}" in pred.columns else F.lit(0.0).alias(f"p_{g}")
                                   for g in "abcde"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _, _ = _fit(spark, sf_dir)
    return forest.split_statistics(model, FEATURES)


def gain_forest(spark: SparkSession, sf_dir: str) -> tuple[gainforest.Forest, DataFrame, DataFrame]:
    """(forest by gain ratio, training rows, held-out rows) of the 80/20 split."""
    data = materialize(sampling.split_relative(model_input(spark, sf_dir), "row_id", 0.8))
    train = data.where(F.col("partition") == "train").drop("partition")
    return gainforest.fit(train, FEATURES, LABEL, "row_id", trees=NUM_TREES), train, data.where(F.col("partition") == "test").drop("partition")


def gain_forest_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4 with M1 as the learner is set: gain ratio, learnt side for missing values, no depth cap."""
    model, _, test = gain_forest(spark, sf_dir)
    return _scored(gainforest.predicted(gainforest.votes(model, test, "row_id"), model.classes))


def out_of_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: every training row with the votes of the trees whose bag lacks it."""
    model, train, _ = gain_forest(spark, sf_dir)
    told = gainforest.predicted(gainforest.votes(model, train, "row_id", out_of_bag=True), model.classes)
    share = {c: F.try_divide(F.get("votes", F.lit(i)), F.col("n_votes")) for i, c in enumerate(model.classes)}
    return told.select("row_id", LABEL, "prediction", "confidence", "n_votes", *(share.get(g, F.lit(0.0)).alias(f"p_{g}") for g in "abcde"))
