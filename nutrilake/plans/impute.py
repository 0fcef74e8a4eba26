"""Q2: fill blank categories from the most similar product name.

Reference: all products with a category (P3, names lower-cased, F30). To complete: products whose
category is null or blank (P4). Names are embedded (M6), matched by the
inverted-file search (M5 + J6, top 1, nprobe 16) and the neighbour's
category is taken when the cosine reaches 0.55 (F32), else ''. A9 reports
the completion rate.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nutrilake.functions import missing
from nutrilake.operators import embed, knn
from nutrilake.session import materialize, shared_path
from nutrilake.sources import files, staged, tables

THRESHOLD = 0.55
NPROBE = 16


def fill_from_neighbours(df: DataFrame, target: str, reference: DataFrame, threshold: float = THRESHOLD,
                         nprobe: int = NPROBE) -> DataFrame:
    """Generic Q2/Q3 step on a table with ``row_id``, ``product_name`` and
    ``target`` (added as '' when absent, P5)."""
    if target not in df.columns:
        df = df.withColumn(target, F.lit(""))
    ref = files.valid_reference(reference, "product_name", target)
    # Equal names are one reference, their first row, and one query: more would not change a result.
    ref = ref.groupBy("product_name").agg(F.min(F.struct("row_id", F.col(target).alias("_t"))).alias("r")) \
        .select("r.row_id", "product_name", F.col("r._t").alias(target))
    ref = embed.add_hashing_embedding(ref, F.col("product_name"), "v")
    ref = materialize(ref.select(F.col("row_id").alias("rid"), F.col(target).alias("_value"), "v"))
    todo = missing.is_blank(F.col(target)) & F.col("product_name").isNotNull()
    asked = materialize(df.where(todo).groupBy(F.lower("product_name").alias("_name")).agg(F.min("row_id").alias("row_id")))
    queries = embed.add_hashing_embedding(asked, F.col("_name"), "v").select("row_id", "v")
    best = knn.ivf_knn(queries, "row_id", "v", ref, "rid", "v", k=1, nprobe=nprobe)
    best = best.join(ref.select("rid", "_value"), "rid").join(asked, F.col("qid") == F.col("row_id")).select("_name", "score", "_value")
    out = df.join(best, todo & (F.lower("product_name") == F.col("_name")), "left")
    mask = missing.is_blank(F.col(target))
    accepted = mask & F.col("score").isNotNull() & (F.col("score") >= threshold)
    return out.select(*[c for c in df.columns if c != target],
                      F.when(mask, F.when(accepted, F.coalesce(F.col("_value"), F.lit(""))).otherwise(F.lit("")))
                      .otherwise(F.col(target)).alias(target),
                      mask.alias("to_complete"), accepted.alias("completed"), F.when(mask, F.col("score")).alias("score"))


def impute_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.products(spark, sf_dir).select("row_id", "code", "product_name", "categories_en")
    return fill_from_neighbours(p, "categories_en", p)


COMPLETED = "row_id long, code string, product_name string, categories_en string, labels_tags string"


def complete_categories(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Q2 as a job: the completed products as CSV at ``path``."""
    return staged.replace_csv(impute_categories(spark, sf_dir).select("row_id", "code", "product_name", "categories_en"), path)


def complete_labels(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Q3 as a job: reads the file of the categories job, adds or fills ``labels_tags`` and replaces the file."""
    table = staged.read_csv(spark, path, "row_id long, code string, product_name string, categories_en string")
    filled = fill_from_neighbours(table, "labels_tags", tables.labelled_products(spark, sf_dir))
    return staged.replace_csv(filled.select("row_id", "code", "product_name", "categories_en", "labels_tags"), path)


def impute_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2 into Q3 over one path: the second job reads and replaces what the first wrote."""
    path = shared_path(spark, "chains", uuid.uuid4().hex)
    complete_categories(spark, sf_dir, path)
    complete_labels(spark, sf_dir, path)
    return staged.read_csv(spark, path, COMPLETED)


def impute_categories_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = impute_categories(spark, sf_dir)
    agg = i.agg(F.count_if("to_complete").alias("to_complete"), F.count_if("completed").alias("completed"))
    return agg.select("to_complete", "completed",
                      F.try_divide(F.col("completed") * 100.0, F.col("to_complete")).alias("pct_completed"))
