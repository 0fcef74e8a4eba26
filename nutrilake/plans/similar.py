"""Similar and better-rated products (Q7), category vote (Q8, A8) and
two-text similarity (F18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nutrilake.operators import textsim
from nutrilake.plans.lookups import questions_enriched, resolve_reference_df
from nutrilake.sources import tables

K = 5


def product_vectors(products: DataFrame) -> DataFrame:
    docs = products.select("row_id", textsim.similarity_text(
        F.col("product_name"), F.col("categories_en"), F.col("ingredients_text"), F.col("brands_tags"))
        .alias("text"))
    v = textsim.tfidf_fit(docs, "row_id", "text", textsim.load_stop_words())
    return v.withColumnRenamed("row_id", "doc")


def product_meta(products: DataFrame) -> DataFrame:
    return products.select(F.col("row_id").alias("doc"), "code", F.col("nutrition_grade_fr").alias("grade"),
                           F.col("nutrition_score_fr_100g").alias("score"))


def question_targets(spark: SparkSession, sf_dir: str, intents: list[str]) -> DataFrame:
    """Questions of the given intents whose reference resolves to a product."""
    q = questions_enriched(spark, sf_dir).where(F.col("intention").isin(intents)) \
        .select("q_id", F.col("reference_deduite").alias("ref")).where(F.col("ref") != "")
    p = tables.products(spark, sf_dir).select("row_id", "code", "product_name")
    r = resolve_reference_df(q, p).where(F.col("row_id").isNotNull())
    return r.select(F.col("q_id").alias("tid"), F.col("row_id").alias("doc"))


def _similar(spark, sf_dir, targets, better_only):
    p = tables.products(spark, sf_dir)
    top = textsim.top_k_similar(targets, product_vectors(p), product_meta(p), K, better_only)
    return top.join(p.select(F.col("row_id").alias("doc"), "product_name", "nutrition_grade_fr"), "doc") \
        .select(F.col("tid").alias("q_id"), "rank", F.col("doc").alias("row_id"), "product_name",
                "nutrition_grade_fr", "similarite")


def similar_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir, question_targets(spark, sf_dir, ["similarite", "categorie"]), False)


def better_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir, question_targets(spark, sf_dir, ["similarite", "categorie"]), True)


def similar_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product -> its 5 most similar products (recommendations)."""
    p = tables.products(spark, sf_dir)
    targets = p.select(F.col("row_id").alias("tid"), F.col("row_id").alias("doc"))
    top = textsim.top_k_similar(targets, product_vectors(p), product_meta(p), K, False)
    return top.select(F.col("tid").alias("target_row_id"), "rank", F.col("doc").alias("row_id"), "similarite")


# Category words that do not count as a category.
IGNORED_CATEGORIES = ["null", "undefined"]


def vote_categories(top: DataFrame, categories: DataFrame) -> DataFrame:
    """A8 over (q_id, rank, row_id) neighbours and (row_id, categories_en):
    categories split on ',', trimmed, blank and null/undefined dropped; the
    3 most common (ties: first seen); suggestion = the first, else
    ``Categorie indeterminee``."""
    cats = (top.join(categories, "row_id")
            .select("q_id", "rank", F.posexplode(F.split(F.coalesce("categories_en", F.lit("")), ",")).alias("i", "c"))
            .select("q_id", "rank", "i", F.trim("c").alias("c"))
            .where((F.col("c") != "") & ~F.lower(F.col("c")).isin(IGNORED_CATEGORIES)))
    counts = cats.groupBy("q_id", "c").agg(F.count(F.lit(1)).alias("n"),
                                           F.min(F.struct("rank", "i")).alias("first_seen"))
    w = Window.partitionBy("q_id").orderBy(F.desc("n"), F.asc("first_seen"))
    top3 = counts.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= 3)
    agg = top3.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("pos", "c", "n"))).alias("t"))
    all_q = top.select("q_id").distinct()
    return all_q.join(agg, "q_id", "left").select(
        "q_id",
        F.coalesce(F.get(F.col("t"), 0)["c"], F.lit("Categorie indeterminee")).alias("categorie_suggeree"),
        F.coalesce(F.array_join(F.transform("t", lambda x: F.concat(x["c"], F.lit(":"), x["n"].cast("string"))),
                                "; "), F.lit("")).alias("categories_preuves"),
        F.transform("t", lambda x: F.struct(x["c"].alias("categorie"), x["n"].alias("n"))).alias("categories_liste"),
        F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("t", lambda x: F.concat(
            F.lit("('"), x["c"], F.lit("', "), x["n"].cast("string"), F.lit(")"))), ", "), F.lit("")),
            F.lit("]")).alias("categories_repr"))


def category_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: category suggestion from the 5 most similar products."""
    sim = similar_products(spark, sf_dir).select("q_id", "rank", "row_id")
    p = tables.products(spark, sf_dir).select("row_id", "categories_en")
    return vote_categories(sim, p).select("q_id", "categorie_suggeree", "categories_preuves")


def text_pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18 on every product: its name against its category text."""
    p = tables.products(spark, sf_dir)
    return p.select("row_id", textsim.pair_similarity(F.col("product_name"), F.col("ingredients_text"))
                    .alias("similarite"))
