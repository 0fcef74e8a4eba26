"""R2: question stream. Each question gets its intent (F21), barcode
and additive code (F5); stateless, so it runs unchanged on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nutrilake.functions import questions as Q
from nutrilake.operators.lookup import additive_code
from nutrilake.sources import tables
from nutrilake.streaming.common import run_available_now, run_folder

QUESTION_SCHEMA = "q_id bigint, conv_id bigint, turn bigint, question string, indice_produit string, codebarres string"


def tag_questions(q: DataFrame) -> DataFrame:
    return q.select("q_id", "question",
                    Q.detect_intent(F.col("question")).alias("intention"),
                    Q.extract_barcode(F.col("question"), F.col("codebarres")).alias("codebarres_effectif"),
                    additive_code(F.col("question")).alias("code_additif"))


def question_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_questions(tables.questions(spark, sf_dir))


def question_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = run_folder(spark, "questions")
    tables.questions(spark, sf_dir).write.mode("errorifexists").json(f"{base}/in")
    stream = spark.readStream.schema(QUESTION_SCHEMA).json(f"{base}/in")
    run_available_now(tag_questions(stream), f"{base}/out", f"{base}/chk")
    return spark.read.parquet(f"{base}/out")
