"""Connected components of an edge table, by alternating large and small stars over checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nutrilake.session import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` for every node of an edge but the roots themselves; a root is its component's smallest node.

    Each round lets every node pass its smallest neighbour to its larger ones and then to its smaller ones; it ends
    when no edge changes. Only two numbers a round reach the driver. Self-loops and repeated edges do no harm.
    """
    now = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = _fingerprint(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(own.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now = materialize(small)
        if (then := _fingerprint(now)) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = then
