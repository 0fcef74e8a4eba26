"""Helpers for the file-based streams: each run writes its JSON input and
its parquet output under a fresh folder of the shared checkpoint folder,
and drives the stream with an ``availableNow`` trigger (all data present
at start, then stop). Restarting from the same checkpoint resumes exactly
once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from nutrilake.session import shared_path


def run_folder(spark: SparkSession, name: str) -> str:
    return shared_path(spark, "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def run_available_now(stream: DataFrame, out_path: str, checkpoint: str, timeout_s: int | None = None) -> None:
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out_path))
    if timeout_s is None:
        q.awaitTermination()
    else:
        q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError(f"stream into {out_path} did not finish in {timeout_s}s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
