"""Input tables.

``read_table`` scans one parquet table of a data folder. The derived tables
(products, questions, external products, distributors, additives) are lazy
DataFrames over those scans, so every query built on them grows with the
input and keeps parquet column pruning and filter push-down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# The distributor dimension of the cleaning flow (name, year kept as text).
DISTRIBUTORS = [
    ("Carrefour", "2025"),
    ("Auchan", "2024"),
    ("Leclerc", "2023"),
    ("Lidl", "2022"),
    ("Intermarche", "2021"),
]

# The local additive dictionary (code, name, role, description, source, source url).
ADDITIVES = [
    ("E100", "Curcumine", "colorant",
     "Colorant jaune d'origine naturelle, souvent extrait du curcuma.",
     "Open Food Facts", "https://fr.openfoodfacts.org/additif/e100-curcumine"),
    ("E200", "Acide sorbique", "conservateur",
     "Conservateur utilisé pour limiter le développement de levures et moisissures.",
     "Open Food Facts", "https://fr.openfoodfacts.org/additif/e200-acide-sorbique"),
    ("E202", "Sorbate de potassium", "conservateur",
     "Sel de l'acide sorbique, utilisé pour prolonger la conservation des aliments.",
     "Open Food Facts", "https://fr.openfoodfacts.org/additif/e202-sorbate-de-potassium"),
    ("E300", "Acide ascorbique", "antioxydant",
     "Vitamine C utilisée comme antioxydant pour limiter l'oxydation.",
     "Open Food Facts", "https://fr.openfoodfacts.org/additif/e300-acide-ascorbique"),
    ("E322", "Lécithines", "émulsifiant",
     "Famille d'émulsifiants utilisés pour stabiliser les mélanges eau/gras.",
     "Open Food Facts", "https://fr.openfoodfacts.org/additif/e322-lecithines"),
    ("E330", "Acide citrique", "acidifiant",
     "Acidifiant très courant qui ajuste l'acidité et améliore parfois la conservation ou le goût.",
     "Open Food Facts", "https://fr.openfoodfacts.org/additif/e330-acide-citrique"),
    ("E331", "Citrates de sodium", "correcteur d'acidité",
     "Régule l'acidité et peut stabiliser certaines boissons et préparations.",
     "Open Food Facts", "https://fr.openfoodfacts.org/additif/e331-citrates-de-sodium"),
]

ADDITIVE_SCHEMA = T.StructType([
    T.StructField(name, T.StringType(), False)
    for name in ("code", "nom", "role", "description", "source_nom", "url_source")
])

DISTRIBUTOR_SCHEMA = T.StructType([
    T.StructField("Distributeur", T.StringType(), False),
    T.StructField("Temps", T.StringType(), False),
])

BARCODE_BASE = 3000000000000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def distributors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DISTRIBUTORS, DISTRIBUTOR_SCHEMA)


def additives(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADDITIVES, ADDITIVE_SCHEMA)


def _case(key: Column, mapping: list[tuple[int, object]], default: object = None) -> Column:
    expr = None
    for k, v in mapping:
        value = v if isinstance(v, Column) else F.lit(v)
        expr = F.when(key == k, value) if expr is None else expr.when(key == k, value)
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product per ``part`` row (FIXTURES B.1): names, brands, categories,
    countries with every flavour of missing value, and nutrients per 100 g."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    # nation has 25 rows by definition of the schema: a bounded broadcast.
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    k = F.col("p_partkey")
    joined = part.join(nation, nation["n_nationkey"] == F.pmod(k, F.lit(25)), "left")
    additive_num = _case(F.pmod(k, F.lit(6)), [(0, 100), (1, 200), (2, 322), (3, 330), (4, 331)], 951)

    def d(x: Column) -> Column:
        return x.cast("double")

    return joined.select(
        k.alias("row_id"),
        (F.lit(BARCODE_BASE) + k).cast("string").alias("code"),
        F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("product_name"),
        F.when(k % 31 == 0, F.lit(None).cast("string"))
        .otherwise(F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")))).alias("brands_tags"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 11 == 0, F.lit(" "))
        .otherwise(F.concat(F.lit("Foods, "), F.col("p_type"))).alias("categories_en"),
        F.when(k % 13 == 0, F.lit(None).cast("string")).when(k % 17 == 0, F.lit("nan"))
        .otherwise(F.col("n_name")).alias("countries_en"),
        F.concat(F.lit("water, sugar, E"), additive_num.cast("string"), F.lit(", "), F.col("p_name"))
        .alias("ingredients_text"),
        d((k * 41) % 3700).alias("energy_100g"),
        F.when(k % 101 == 0, F.lit(-1.0)).otherwise(d((k * 37) % 1050) / 10.0).alias("sugars_100g"),
        (d((k * 53) % 130) / 10.0).alias("saturated_fat_100g"),
        (d((k * 53) % 130 + (k * 17) % 400) / 10.0).alias("fat_100g"),
        F.when(k % 97 == 0, F.lit(100.0)).otherwise(d((k * 29) % 300) / 100.0).alias("salt_100g"),
        F.when(k % 97 == 0, F.lit(40.0)).otherwise(d((k * 29) % 300) / 100.0 / 2.5).alias("sodium_100g"),
        F.when(k % 19 == 0, F.lit(None).cast("double")).otherwise(d((k * 13) % 120) / 10.0).alias("fiber_100g"),
        (d((k * 19) % 250) / 10.0).alias("proteins_100g"),
        d((k * 7) % 101).alias("fruits_100g"),
        F.when(k % 5 == 0, F.lit(None).cast("int")).otherwise(((k * 11) % 60 - 15).cast("int"))
        .alias("nutrition_score_fr_100g"),
        _case(k % 7, [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "E"), (5, "unknown")], None)
        .cast("string").alias("nutrition_grade_fr"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per ``part`` row (FIXTURES B.2), 20 turns per conversation."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    k = F.col("p_partkey")
    code = (F.lit(BARCODE_BASE) + k).cast("string")
    text = _case(k % 9, [
        (0, "Explique l’additif E330"),
        (1, "Trouve des produits similaires mieux notes"),
        (2, F.concat(F.lit('Propose une catégorie pour "'), F.col("p_name"), F.lit('"'))),
        (3, F.concat(F.lit("Le pays est manquant pour le code-barres "), code)),
        (4, "Ce Nutri-Score est-il cohérent ?"),
        (5, F.concat(F.lit('Estime le nutriscore de "'), F.col("p_name"), F.lit('"'))),
        (6, "e150a est-il sain ?"),
        (7, "E 322 : quel role ?"),
    ], "Bonjour")
    return part.select(
        k.alias("q_id"),
        F.floor(k / 20.0).cast("bigint").alias("conv_id"),
        (k % 20).alias("turn"),
        text.alias("question"),
        F.when((k % 9).isin(1, 4), F.col("p_name")).otherwise(F.lit(None).cast("string")).alias("indice_produit"),
        F.when(k % 4 == 0, code).otherwise(F.lit(None).cast("string")).alias("codebarres"),
    )


NUTRIMENT_KEYS = [
    # (key in the external nutriments map, products column)
    ("energy-kj_100g", "energy_100g"),
    ("fat_100g", "fat_100g"),
    ("saturated-fat_100g", "saturated_fat_100g"),
    ("sugars_100g", "sugars_100g"),
    ("salt_100g", "salt_100g"),
    ("fiber_100g", "fiber_100g"),
    ("proteins_100g", "proteins_100g"),
    ("fruits-vegetables-nuts-estimate-from-ingredients_100g", "fruits_100g"),
]


def external_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product reference source standing in for the public product service
    (FIXTURES B.4): every third product, flat fields plus a ``nutriments`` map."""
    p = products(spark, sf_dir).where(F.col("row_id") % 3 == 0)
    rid = F.col("row_id")
    return p.select(
        "code",
        "product_name",
        F.col("brands_tags").alias("brands"),
        F.col("categories_en").alias("categories"),
        F.when(rid % 2 == 0, F.col("countries_en")).otherwise(F.lit(None).cast("string")).alias("countries"),
        F.when(F.col("countries_en").isNull(), F.lit(None).cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("en:"), F.lower(F.col("countries_en"))))).alias("countries_tags"),
        F.col("nutrition_grade_fr").alias("nutrition_grades"),
        F.when(rid % 2 == 0, F.concat(F.lit("https://images.example/"), F.col("code"), F.lit("/front.jpg")))
        .otherwise(F.lit(None).cast("string")).alias("image_front_url"),
        F.when(rid % 5 != 0, F.concat(F.lit("https://images.example/"), F.col("code"), F.lit(".jpg")))
        .otherwise(F.lit(None).cast("string")).alias("image_url"),
        F.col("nutrition_score_fr_100g"),
        F.map_from_arrays(
            F.array(*[F.lit(key) for key, _ in NUTRIMENT_KEYS]),
            F.array(*[F.col(c) for _, c in NUTRIMENT_KEYS]),
        ).alias("nutriments"),
    )


def labelled_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference of the labels job: products with ``labels_tags`` from their kind and brand; every fourth has none, every tenth an empty one."""
    k = F.col("p_partkey")
    tags = F.concat(F.lit("en:"), F.lower("p_type"), F.lit(",en:"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))))
    return read_table(spark, sf_dir, "part").select(
        k.alias("row_id"), F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("product_name"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 10 == 1, F.lit("")).otherwise(tags).alias("labels_tags"))


def external_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The external source with one row a code: the first by its flat fields."""
    ext = external_products(spark, sf_dir)
    flat = F.struct(*(c for c, kind in ext.dtypes if "map" not in kind))
    return ext.groupBy("code").agg(F.min_by(F.struct(*ext.columns), flat).alias("p")).select("p.*")
