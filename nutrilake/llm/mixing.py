"""Mixing sources to target weights by weighted fair queueing (operator 6), in DataFrame operations only.

Every source is a queue of its documents in shuffled order, repeated as often
as allowed. A document's virtual finish time is its source's words up to and
with it, divided by the source's target. All copies are sorted by that time
over the whole table, and the mix is the longest head of that order whose
words fit the budget: every source advances in proportion to its target.

Running totals never need a source in one task: a source is cut into buckets
by the shuffle hash, bucket totals give each bucket its start, and only rows
of a bucket are summed in order. The last cut works alike over ranges of the
virtual time.

Null texts have size 0; documents of size 0 are taken 0 words. A null source
is a source of its own, last in order. Repeated rows (equal in id and text)
are documents of their own that share a place in the shuffle in either
order; rows of one id in several sources are documents of each of them, and
rows without an id are shuffled by their text. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nutrilake.session import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def shuffle_key(doc_id: Column, text: Column, seed: str) -> Column:
    """A hex hash of the id; of the text where there is no id."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.md5(text))))


def running_start(value: str) -> Column:
    """What the ranges before a range add up to; for tables of one row a range, a fixed number of rows."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(before), F.lit(0)).alias("_start")


def source_ranks(sources: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """Adds ``rank`` (from 0, by code point, null last) to one row a source, without a global window."""
    last = F.col(key).isNull()
    dealt = materialize(sources.repartitionByRange(buckets, last, F.col(key)).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row a range: ``buckets`` rows.
    start = counts.select("_part", running_start("_n"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_last())) - 1
    return dealt.join(F.broadcast(start), "_part").withColumn("rank", own + F.col("_start")).drop("_part", "_start")


def capped_targets(sources: DataFrame, budget: int, most: int) -> DataFrame:
    """Adds ``target``: the budget by ``weight``, at most ``most`` times ``source_size``, the excess dealt again by weight.

    One small aggregate a round gives the level (words a unit of weight); a
    round ends at least one source's claim, and none is needed once no
    source is above its cap.
    """
    cap = F.col("source_size") * most
    level = None
    while True:
        full = F.lit(False) if level is None else cap <= F.lit(level) * F.col("weight")
        got = sources.agg(F.sum(F.when(full, cap)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("weights"),
                          F.sum(F.when(full, 1).otherwise(0)).alias("n")).first()
        now = None if not got["weights"] else (budget - (got["used"] or 0)) / got["weights"]
        if now is None or now == level:
            break
        level = now
    claim = F.lit(float(level or 0.0)) * F.col("weight")
    return sources.withColumn("target", cap.cast("double") if level is None or now is None else F.least(cap.cast("double"), claim))


def fair_mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
             weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", bucket_digits: int = 3) -> DataFrame:
    """One row a document: id, source, ``size``, ``source_size``, ``target`` of its source, ``copies`` taken and ``taken`` words.

    ``key`` (``shuffle_key``) is the shuffled order, its first ``bucket_digits`` digits the bucket; ``upto``
    tells repeated rows of one id apart.
    """
    sized = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                                    shuffle_key(F.col(doc_id), F.col(text), seed).alias("key")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = source_ranks(totals, "source")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight))
    budget = ranked.agg(F.sum("source_size")).first()[0] or 0
    sources = capped_targets(ranked, budget, most).select(F.col("source").alias("s"), "source_size", "target")

    queued = sized.withColumn("bucket", F.substring("key", 1, bucket_digits))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = queued.groupBy("source", "bucket").agg(F.sum("size").alias("words")) \
        .withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))) \
        .join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("words", "s") \
        .withColumnsRenamed({"source": "s", "bucket": "b"})
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    line = queued.withColumn("upto", F.sum("size").over(within)) \
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))) \
        .withColumn("upto", F.col("upto") + F.col("ahead")).drop("s", "b", "ahead", "bucket")
    line = materialize(line)

    finish = F.try_divide(F.col("upto") + F.col("copy") * F.col("source_size"), F.col("target"))
    copies = line.where(F.col("size") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))) \
        .withColumn("finish", finish)
    counts = cut_at_budget(copies, ["finish", "source", "key", "doc_id", "copy"], "size", budget) \
        .groupBy("source", "key", "doc_id", "upto").agg(F.count("*").alias("copies"))
    mine = counts.select(F.col("source").alias("s"), F.col("key").alias("k"), F.col("doc_id").alias("i"), F.col("upto").alias("u"), "copies")
    same = (F.col("key") == F.col("k")) & (F.col("upto") == F.col("u")) & F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s"))
    return line.join(mine, same & (F.col("size") > 0), "left") \
        .select("doc_id", "source", "key", "upto", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).cast("bigint").alias("copies"),
                (F.coalesce("copies", F.lit(0)) * F.col("size")).cast("bigint").alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The rows of ``docs`` (with ``doc_id``, ``source`` and ``text``) as the mix takes them: each as often as it is taken.

    Rows that share id, source, size and shuffle key are told apart by their number among themselves on both sides.
    """
    same = ["doc_id", "source", "_size", "_key"]
    number = Window.partitionBy(*same)
    taken = fair_mix(docs, seed=seed, **options).withColumnsRenamed({"size": "_size", "key": "_key"}) \
        .withColumn("_n", F.row_number().over(number.orderBy("upto"))).where("copies > 0") \
        .select(*(F.col(c).alias(f"_t_{c}") for c in [*same, "_n"]), F.col("copies").cast("int").alias("_copies"))
    rows = docs.withColumn("_size", word_count(F.col("text"))).withColumn("_key", shuffle_key(F.col("doc_id"), F.col("text"), seed)) \
        .withColumn("_n", F.row_number().over(number.orderBy(F.xxhash64("text"))))
    match = F.lit(True)
    for c in [*same, "_n"]:
        match = match & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    return rows.join(taken, match).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))) \
        .select(*(f"`{c}`" for c in docs.columns))


def cut_at_budget(rows: DataFrame, order: list[str], size: str, budget: int, least_parts: int = 256) -> DataFrame:
    """The longest head of ``rows`` in the given order whose ``size`` adds up to at most ``budget``."""
    parts = max(least_parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum(size).alias("_sum"))
    # One row a range, as many as there are shuffle partitions.
    start = sums.select("_part", running_start("_sum"))
    upto = F.sum(size).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(start), "_part").withColumn("_upto", upto + F.col("_start")) \
        .where(F.col("_upto") <= budget).drop("_part", "_start", "_upto")


#: What the production query gives, as DuckDB SQL.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(concat_ws(':', 'mix', coalesce(CAST(doc_id AS VARCHAR), md5(text)))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source) AS i FROM s),
lv AS (SELECT i, source_size, weight,
              ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
l AS (SELECT arg_min(level, i) AS level FROM lv WHERE 3 * source_size > level * weight),
t AS (SELECT source, source_size,
             least(CAST(3 * source_size AS DOUBLE), coalesce((SELECT level FROM l), 1e300) * weight) AS target FROM s),
q AS (SELECT d.*, source_size, target,
             sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, copy, (upto + copy * source_size) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0),
m AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, key, doc_id, copy ROWS UNBOUNDED PRECEDING) AS used FROM c),
k AS (SELECT source, key, doc_id, upto, count(*) AS copies FROM m WHERE used <= (SELECT sum(size) FROM d) GROUP BY source, key, doc_id, upto)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(k.copies, 0) * q.size AS BIGINT) AS taken
FROM q LEFT JOIN k ON q.key = k.key AND q.upto = k.upto AND q.doc_id IS NOT DISTINCT FROM k.doc_id
     AND q.source IS NOT DISTINCT FROM k.source AND q.size > 0
"""
