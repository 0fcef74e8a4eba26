"""Exact, repeatable sampling and splitting.

Rows are ordered by ``md5(key || seed)`` (then key). The first ``n`` rows in
that order are found without a global sort or a single-partition window:
rows are counted per hash-prefix bucket (a partial aggregate over at most
2^20 buckets), the boundary bucket is located on that small histogram, and
only the rows of the boundary bucket are ranked. The md5 order is the same
in any SQL engine, which makes the result checkable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 5  # hex digits of the bucket prefix: 16^5 = 1 048 576 buckets


def hash_order(key: Column, seed: str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def mark_first(df: DataFrame, key: str, seed: str, n: Column, flag: str = "_selected") -> DataFrame:
    """Add boolean ``flag``: row is among the first ``n`` in md5 order.
    ``n`` may be a literal or a scalar sub-query."""
    h = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, PREFIX))
    hist = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_cnt"))
    cum = hist.withColumn("_before", F.coalesce(F.sum("_cnt").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = cum.where((F.col("_before") < n) & (F.col("_before") + F.col("_cnt") >= n)) \
        .select(F.struct(F.col("_b").alias("b"), (n - F.col("_before")).alias("need")).alias("s"))
    cut_row = cut.scalar()
    ranked = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    boundary = h.where(F.col("_b") == cut_row["b"]).withColumn(flag, ranked <= cut_row["need"])
    # no boundary: n = 0, or n >= number of rows
    rest = h.where(cut_row.isNull() | (F.col("_b") != cut_row["b"])) \
        .withColumn(flag, F.when(cut_row.isNull(), n > 0).otherwise(F.col("_b") < cut_row["b"]))
    return rest.unionByName(boundary).drop("_h", "_b")


def exact_sample(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the same ones on every run."""
    return mark_first(df, key, seed, F.lit(n)).where(F.col("_selected")).drop("_selected")


def split_relative(df: DataFrame, key: str, fraction: float = 0.8, seed: str = "1678807467440",
                   label: str = "partition", first: str = "train", second: str = "test") -> DataFrame:
    """L6 + L7: floor(fraction * rows) rows in md5 order go to ``first``, the
    rest to ``second``; an empty input fails the job."""
    # An empty input is an error (a one-row probe, checked when the plan is built)
    if not df.limit(1).count():
        raise ValueError("empty table: nothing to split")
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    n_first = F.floor(total * F.lit(fraction)).cast("bigint")
    marked = mark_first(df, key, seed, n_first, "_first")
    return marked.withColumn(label, F.when(F.col("_first"), F.lit(first)).otherwise(F.lit(second))).drop("_first")
