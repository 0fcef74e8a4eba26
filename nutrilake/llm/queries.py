"""Query keys of the operators: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where it expresses them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nutrilake.llm import alignment, bpe, embeddings, flatfiles, hashtree, minhash, mixing, pii, quality, repeats, toxicity, whitening, wrappers
from nutrilake.session import ensure_checkpoint_dir, materialize
from nutrilake.sources.tables import read_table

END_OF_DOCUMENT = 50256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return read_table(spark, sf_dir, "documents")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cascade(documents(spark, sf_dir).select("doc_id", "text"), figures=quality.BASE_FIGURES).drop("text")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return wrappers.main_texts(read_table(spark, sf_dir, "pages"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.fair_mix(documents(spark, sf_dir))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = flatfiles.scratch_folder(spark, "tokens")
    docs = documents(spark, sf_dir)
    flatfiles.write_token_files(docs, path, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN, END_OF_DOCUMENT)
    counts = materialize(flatfiles.separator_scan(spark, path, END_OF_DOCUMENT, with_ids=True).select("doc_id", "n_tokens"))
    flatfiles.drop_folder(spark, path)
    return counts


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)


def op9_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return embeddings.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.find(docs, pii.learn_field(docs))


def op11_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashtree.sharded(documents(spark, sf_dir), hashtree.TREE, hashtree.BIGGER)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), public_tokenizers.path(alignment.A_FILE), public_tokenizers.path(alignment.B_FILE))


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_toxicity": op2_toxicity,
    "op3_repeated_substrings": op3_repeated_substrings,
    "op4_quality_rules": op4_quality_rules,
    "op5_main_text": op5_main_text,
    "op6_source_mix": op6_source_mix,
    "op7_token_counts": op7_token_counts,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_embedding_duplicates": op9_embedding_duplicates,
    "op10_personal_data": op10_personal_data,
    "op11_hash_tree": op11_hash_tree,
    "op12_whitening": op12_whitening,
    "op13_alignment": op13_alignment,
}
ORACLE = {
    "op4_quality_rules": quality.ORACLE_SQL,
    "op6_source_mix": mixing.ORACLE_SQL,
    "op11_hash_tree": hashtree.ORACLE_SQL,
}
