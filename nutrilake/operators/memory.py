"""Conversation memory (W1, W2, F25) without a window over whole conversations.

* ``last_turns`` keeps the last N turns of every conversation with a
  ``row_number`` limit, which Spark applies as a partial window group limit
  before the shuffle, so a conversation holding a third of the rows never
  reaches one task whole.
* ``recent_context`` renders, for each turn, the previous ``k`` turns. All
  turns are range-sorted by conversation and turn and numbered over the whole
  table, so that turn numbers may have gaps; the previous k turns are an
  equi-join on (conversation, number - j), j = 1..k: groups hold at most k
  rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nutrilake.session import materialize

NO_HISTORY = "Aucun historique disponible."


def last_turns(df: DataFrame, conv: str, turn: str, n: int = 12) -> DataFrame:
    """The last ``n`` turns of each conversation."""
    w = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def summary(text: Column, max_len: int = 260) -> Column:
    """strip surrounding whitespace, newlines -> spaces, first ``max_len`` characters."""
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.substring(F.replace(stripped, F.lit("\n"), F.lit(" ")), 1, max_len)


def numbered(base: DataFrame, parts: int = 64) -> DataFrame:
    """Adds ``_t``: the number of each row in the order of (``_c``, ``_turn``, ``_line``) over the whole table.

    Rows are range-sorted; the ranges' row counts (one row a range) give each range its start.
    """
    dealt = materialize(base.repartitionByRange(parts, "_c", "_turn", "_line").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")) \
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_c", "_turn", "_line"))
    return dealt.join(F.broadcast(start), "_part").withColumn("_t", own + F.col("_start")).drop("_part", "_start")


def recent_context(entries: DataFrame, conv: str, turn: str, line: Column, k: int = 5) -> DataFrame:
    """(conv, turn, contexte) where contexte lists the previous ``k``
    entries oldest first as ``i. <line>``; no previous entry -> NO_HISTORY."""
    base = numbered(entries.select(F.col(conv).alias("_c"), F.col(turn).alias("_turn"), line.alias("_line")))
    shifted = base.select("_c", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("_j"), "_t", "_line") \
        .select("_c", (F.col("_t") + F.col("_j")).alias("_target"), "_t", "_line")
    hist = (shifted.groupBy("_c", "_target")
            .agg(F.array_sort(F.collect_list(F.struct("_t", "_line"))).alias("_h")))
    rendered = F.array_join(F.transform(
        F.col("_h"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["_line"])), "\n")
    return (base.select("_c", F.col("_t").alias("_target"), "_turn")
            .join(hist, ["_c", "_target"], "left")
            .select(F.col("_c").alias(conv), F.col("_turn").alias(turn),
                    F.when(F.col("_h").isNull(), F.lit(NO_HISTORY)).otherwise(rendered).alias("contexte")))
