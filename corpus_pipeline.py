"""The corpus pipeline: documents to token ids, in stages that each call one operator of ``nutrilake.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes it as Parquet in the shared folder and reads it again as the next
stage's documents. All but the last return the columns of ``documents``. An
extra column that bears the name of an operator's output is dropped.

Nulls, empty and very long texts, repeated rows and empty tables follow the
operators' own rules: texts without words are rejected by the quality rules,
rows without a doc_id pass the near-duplicate stage, and of rows that share a
doc_id one stays there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nutrilake.llm import bpe, flatfiles, minhash, mixing, pii, quality
from nutrilake.session import ensure_checkpoint_dir
from nutrilake.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    ensure_checkpoint_dir(spark)
    judged = quality.cascade(docs, base=())
    return judged.where("kept").drop("base_failed", "kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id."""
    ensure_checkpoint_dir(spark)
    first = minhash.near_duplicates(docs).where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *(F.col(f"`{c}`") for c in rest))).alias("row"))
    one = one.select("doc_id", "row.*").select(*(f"`{c}`" for c in docs.columns))
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows the new text."""
    ensure_checkpoint_dir(spark)
    clean = pii.redact(docs, pii.learn_field(docs))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ensure_checkpoint_dir(spark)
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN, ids="ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("byte-level bpe", token_ids),
]

#: The near-duplicate, personal-data and encoding stages have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_checkpoint_dir(spark)
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = flatfiles.scratch_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            flatfiles.drop_folder(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
