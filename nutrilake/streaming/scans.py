"""Scan stream scoring. Each scan ``{code, ts}`` is joined (stream-static
left join) with the product reference source and scored (F12); an unknown
code gives an ``erreur`` row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nutrilake.functions import nutrition as N
from nutrilake.sources import tables
from nutrilake.streaming.common import run_available_now, run_folder

SCAN_SCHEMA = "event_id bigint, ts timestamp, code string"
SCAN_WIRE_SCHEMA = "event_id bigint, ts string, code string"


def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans derived from ``events``: code = base + pmod(event_id, #parts)."""
    n_part = tables.read_table(spark, sf_dir, "part").select(F.count(F.lit(1))).scalar()
    ev = tables.read_table(spark, sf_dir, "events")
    return ev.select("event_id", "ts",
                     (F.lit(tables.BARCODE_BASE) + F.pmod(F.col("event_id"), n_part)).cast("string").alias("code"))


def score_scans(scans: DataFrame, external: DataFrame) -> DataFrame:
    """Works on a batch or a streaming ``scans`` frame."""
    ext = external.select(F.col("code").alias("x_code"), "product_name", "brands", "nutrition_grades",
                          "image_front_url", "image_url", "nutriments")
    j = scans.join(ext, F.trim(F.col("code")) == F.col("x_code"), "left")
    j = N.add_scan_score(j, F.coalesce(F.col("nutriments"), F.create_map().cast("map<string,double>")))
    found = F.col("x_code").isNotNull()
    return j.select(
        "event_id", "ts", "code",
        N.js_or(F.col("product_name"), F.lit("Inconnu")).alias("product_name"),
        N.js_or(F.col("brands"), F.lit("Inconnu")).alias("brands"),
        F.col("_s_nutriscore_predit").alias("nutriscore_predit"),
        N.js_or(F.col("nutrition_grades"), F.lit("Non disponible")).alias("nutriscore_officiel"),
        F.col("_s_score_numerique").alias("score_numerique"),
        *[F.col("_s_" + c).alias(c) for c in ("fat", "sugar", "salt", "proteins", "fiber", "energy_kj", "sat_fat",
                                              "fruits_veg")],
        N.js_or(F.col("image_front_url"), N.js_or(F.col("image_url"), F.lit(None).cast("string"))).alias("image_url"),
        F.when(~found, F.lit("Produit introuvable sur Open Food Facts.")).alias("erreur"),
    )


def scan_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_scans(scan_events(spark, sf_dir), tables.external_by_code(spark, sf_dir))


def scan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the scans as JSON lines, stream them through the scoring with
    ``availableNow`` into parquet, and return the written result."""
    base = run_folder(spark, "scans")
    # the event time travels as ISO text (microseconds kept), parsed back by a cast
    scan_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("string")) \
        .write.mode("errorifexists").json(f"{base}/in")
    stream = spark.readStream.schema(SCAN_WIRE_SCHEMA).json(f"{base}/in") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    run_available_now(score_scans(stream, tables.external_by_code(spark, sf_dir)), f"{base}/out", f"{base}/chk")
    return spark.read.parquet(f"{base}/out")
