"""Q1: clean products -> distributor expansion -> {profile, average chart, CSV}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nutrilake.operators import clean, profile
from nutrilake.sources import tables


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_products(tables.products(spark, sf_dir))


def distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned products x the 5 distributors (13 865 rows in the reference)."""
    return clean.expand_by_dimension(cleaned(spark, sf_dir), tables.DISTRIBUTORS, ["Distributeur", "Temps"])


def distributor_avg_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: average nutrition score per distributor after cleaning.

    Every cleaned product is paired with every distributor, so the average
    per distributor is the average over the cleaned products. The plan
    aggregates first (partial sums map-side, one row per task to the final
    aggregate) and only then pairs the single result row with the five
    distributors: the expansion never multiplies the scanned rows.
    """
    agg = cleaned(spark, sf_dir).agg(
        F.sum("nutrition_score_fr_100g").alias("s"), F.count("nutrition_score_fr_100g").alias("n"))
    per_dist = clean.expand_by_dimension(agg, tables.DISTRIBUTORS, ["Distributeur", "Temps"])
    return per_dist.select("Distributeur", F.try_divide(F.col("s").cast("double"), F.col("n")).alias("avg_nutrition_score"))


def distributor_avg_score_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same answer computed literally (expand, then group) - kept as the
    reference form for tests and for tables that are not a pure expansion."""
    return profile.avg_by(distributed(spark, sf_dir), "Distributeur", "nutrition_score_fr_100g",
                          "avg_nutrition_score")


def clean_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir)


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(cleaned(spark, sf_dir))


def column_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of the cleaned products x distributors. An expansion by a fixed
    dimension adds no product value, so each side is summarised on its own."""
    dims = clean.expand_by_dimension(cleaned(spark, sf_dir).limit(1).select(), tables.DISTRIBUTORS, ["Distributeur", "Temps"])
    return profile.column_domains(cleaned(spark, sf_dir)).unionByName(profile.column_domains(dims))


def domain_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 without a bound: every value of every text column with its count."""
    c = cleaned(spark, sf_dir)
    return profile.value_counts(c, [n for n, t in c.dtypes if t == "string"])
