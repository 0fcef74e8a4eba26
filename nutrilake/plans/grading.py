"""Nutrition grading queries: scan scoring (F12), heuristic grade (F13),
coherence (F14), OK/DIFF rule (F29) and the scorer (A1, A3, A5-A7) applied to
the heuristic estimate against the stored grade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nutrilake.functions import nutrition as N
from nutrilake.functions.rules import ok_diff
from nutrilake.operators import profile, scoring
from nutrilake.sources import tables

CLASSES = ["a", "b", "c", "d", "e", "unknown"]


def with_estimate(df: DataFrame) -> DataFrame:
    return N.add_estimate(N.add_normalized(df, N.products_flat()))


def heuristic_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = with_estimate(tables.products(spark, sf_dir))
    return p.select("row_id", "code", *[F.col("_e_" + c).alias(c) for c in
                                        ("grade_estime", "score_estime", "methode", "justification")])


def grade_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = N.add_coherence(with_estimate(tables.products(spark, sf_dir)))
    return p.select("row_id", "code", F.col("_c_statut").alias("statut"), F.col("_c_message").alias("message"),
                    F.col("_c_grade_actuel").alias("grade_actuel"), F.col("_e_grade_estime").alias("grade_estime"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored grade (lower-cased) against the heuristic estimate."""
    p = with_estimate(tables.products(spark, sf_dir))
    return p.select("row_id", "code", F.lower(F.col("nutrition_grade_fr")).alias("actual"),
                    F.col("_e_grade_estime").alias("predicted"))


def rule_ok_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return s.withColumn("comparaison_nutri", ok_diff(F.col("actual"), F.col("predicted")))


def ok_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.count_by(rule_ok_diff(spark, sf_dir), "comparaison_nutri", "Count(product_name)")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.confusion_matrix(scored(spark, sf_dir), "actual", "predicted", CLASSES)


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.class_scores(scored(spark, sf_dir), "actual", "predicted")


def overall_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.overall_scores(scored(spark, sf_dir), "actual", "predicted")


def nutriment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12 over the product reference source: 14 output columns + code."""
    ext = N.add_scan_score(tables.external_products(spark, sf_dir), F.col("nutriments"))
    return ext.select(
        "code",
        N.js_or(F.col("product_name"), F.lit("Inconnu")).alias("product_name"),
        N.js_or(F.col("brands"), F.lit("Inconnu")).alias("brands"),
        F.col("_s_nutriscore_predit").alias("nutriscore_predit"),
        N.js_or(F.col("nutrition_grades"), F.lit("Non disponible")).alias("nutriscore_officiel"),
        F.col("_s_score_numerique").alias("score_numerique"),
        *[F.col("_s_" + c).alias(c) for c in ("fat", "sugar", "salt", "proteins", "fiber", "energy_kj", "sat_fat",
                                              "fruits_veg")],
        N.js_or(F.col("image_front_url"), N.js_or(F.col("image_url"), F.lit(None).cast("string")))
        .alias("image_url"),
    )
