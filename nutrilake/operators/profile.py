"""Aggregations over product tables: grouped averages and counts (A1-A3),
the 14-statistic column profile (A4) and column domains (A11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nutrilake.session import materialize

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)


def avg_by(df: DataFrame, key: str, value: str, alias: str | None = None) -> DataFrame:
    """A2: AVG(value) per key (partial aggregation map-side)."""
    return df.groupBy(key).agg(F.avg(value).alias(alias or f"avg_{value}"))


def count_by(df: DataFrame, key: str, alias: str = "count") -> DataFrame:
    """A1/A3: rows per key, missing values counted (count(*) not count(col))."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(alias))


def _is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, top_n: int = 10,
                   digits: int = 6) -> DataFrame:
    """A4: one row per column with name, type, #missing, #unique, min, max,
    quartiles, mean, mean absolute deviation, standard deviation, sum and
    the ``top_n`` most common values ("value:count" joined by ", ").

    Two aggregation passes over the table (the mean absolute deviation needs
    the mean) plus one grouped count that gives unique and frequent values and
    the quartiles; no per-column job loop and nothing collected to the driver.
    Quartiles are exact values of the column (lower quantile) at every size.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in (columns or df.columns) if c in fields]
    numeric = [c for c in cols if _is_numeric(fields[c])]

    # pass 1: one wide aggregate
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c)
        aggs.append(F.count_if(x.isNull()).alias(f"m{i}"))
        if c in numeric:
            xd = x.cast("double")
            aggs += [
                F.min(xd).alias(f"mn{i}"), F.max(xd).alias(f"mx{i}"),
                F.avg(xd).alias(f"av{i}"), F.stddev_samp(xd).alias(f"sd{i}"), F.sum(xd).alias(f"sm{i}"),
            ]
    wide = df.agg(*aggs)

    # pass 2: mean absolute deviation against the mean of pass 1 (a 1-row
    # table; the scalar subquery keeps it a broadcast value, not a join)
    mad = None
    if numeric:
        idx = [cols.index(c) for c in numeric]
        means = wide.select(F.struct(*[F.col(f"av{j}") for j in idx]).alias("s")).scalar()
        mad = df.agg(*[F.avg(F.abs(F.col(cols[j]).cast("double") - means[f"av{j}"])).alias(f"md{j}")
                       for j in idx])

    def r(c):
        return F.round(c, digits)

    rows = []
    for i, c in enumerate(cols):
        num = c in numeric
        rows.append(F.struct(
            F.lit(c).alias("column_name"),
            F.lit(fields[c].simpleString()).alias("column_type"),
            F.col(f"m{i}").alias("n_missing"),
            (r(F.col(f"mn{i}")) if num else F.lit(None).cast("double")).alias("min_value"),
            (r(F.col(f"mx{i}")) if num else F.lit(None).cast("double")).alias("max_value"),
            F.lit(None).cast("double").alias("q25"),
            F.lit(None).cast("double").alias("q50"),
            F.lit(None).cast("double").alias("q75"),
            (r(F.col(f"av{i}")) if num else F.lit(None).cast("double")).alias("mean"),
            (F.lit(None).cast("double")).alias("mad"),
            (r(F.col(f"sd{i}")) if num else F.lit(None).cast("double")).alias("stddev"),
            (r(F.col(f"sm{i}")) if num else F.lit(None).cast("double")).alias("sum"),
        ))
    stats = wide.select(F.inline(F.array(*rows)))
    if mad is not None:
        mad_long = mad.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), r(F.col(f"md{cols.index(c)}")).alias("mad_value"))
            for c in numeric
        ])))
        stats = (stats.join(mad_long, "column_name", "left")
                 .withColumn("mad", F.col("mad_value")).drop("mad_value"))
    counts = materialize(value_counts(df, cols))
    if numeric:
        quarters = quartiles(counts.where(F.col("column_name").isin(numeric)))
        found = quarters.select("column_name", *(r(F.col(q)).alias(f"_{q}") for q in QUARTILES))
        stats = stats.join(found, "column_name", "left").withColumns({q: F.col(f"_{q}") for q in QUARTILES}) \
            .drop(*(f"_{q}" for q in QUARTILES))
    unique = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique"))
    top = _top_values(counts, top_n)
    return (stats.join(unique, "column_name", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))
            .join(top, "column_name", "left"))


QUARTILES = ("q25", "q50", "q75")


def quartiles(counts: DataFrame, least_parts: int = 64) -> DataFrame:
    """``column_name`` and the value at rank ceil(k n / 4), k = 1, 2, 3, of the counted numbers.

    Values are sorted by ranges and the counts of the ranges before are added,
    so no task holds more than a range of a column's distinct values."""
    parts = max(least_parts, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbers = counts.select("column_name", F.col("value").cast("double").alias("x"), "n")
    dealt = materialize(numbers.repartitionByRange(parts, "column_name", "x").withColumn("_part", F.spark_partition_id()))
    # One row a column and range.
    sums = dealt.groupBy("column_name", "_part").agg(F.sum("n").alias("_sum"))
    by_range = Window.partitionBy("column_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    ranges = sums.select("column_name", "_part", (F.sum("_sum").over(by_range) - F.col("_sum")).alias("_start"),
                         F.sum("_sum").over(Window.partitionBy("column_name")).alias("_all"))
    own = Window.partitionBy("column_name", "_part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("_own", F.sum("n").over(own)).join(F.broadcast(ranges), ["column_name", "_part"])
    upto = F.col("_own") + F.col("_start")
    return ranked.groupBy("column_name").agg(
        *(F.min(F.when(4 * upto >= k * F.col("_all"), F.col("x"))).alias(q) for k, q in enumerate(QUARTILES, 1)))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value, n) of every value that is not null.

    The unpivot feeds a count with partial aggregation, so a value that holds
    a third of the rows is pre-counted map-side."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n long")
    kinds = dict(df.dtypes)

    def text(c: str):  # 0.0 and -0.0 are one value
        return (F.col(c) + F.lit(0.0) if kinds[c] in ("double", "float") else F.col(c)).cast("string")

    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), text(c).alias("value")) for c in cols
    ]))).where(F.col("value").isNotNull())
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def most_common_values(df: DataFrame, cols: Sequence[str], top_n: int = 10) -> DataFrame:
    """Top-n values per column as text ``value:count`` joined by ", ";
    ties broken by value so the list is deterministic. Nulls are not values."""
    return _top_values(value_counts(df, cols), top_n)


def _top_values(counts: DataFrame, top_n: int) -> DataFrame:
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    ranked = counts.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= top_n)
    return ranked.groupBy("column_name").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rk", "value", "n"))),
                        lambda s: F.concat(s["value"], F.lit(":"), s["n"].cast("string"))),
            ", ").alias("top_values"))


def column_domains(df: DataFrame, columns: Sequence[str] | None = None, max_values: int = 60) -> DataFrame:
    """Numeric lower/upper bound, or for text columns the sorted possible
    values (only when there are at most ``max_values``, as a domain is a
    summary; larger domains give null and their count)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in (columns or df.columns) if c in fields]
    rows = []
    aggs = []
    for i, c in enumerate(cols):
        if _is_numeric(fields[c]):
            aggs += [F.min(F.col(c).cast("double")).alias(f"lo{i}"), F.max(F.col(c).cast("double")).alias(f"hi{i}")]
        else:
            continue
    wide = df.agg(*(aggs or [F.lit(1).alias("_one")]))
    for i, c in enumerate(cols):
        if _is_numeric(fields[c]):
            rows.append(F.struct(F.lit(c).alias("column_name"), F.col(f"lo{i}").alias("lower_bound"),
                                 F.col(f"hi{i}").alias("upper_bound"),
                                 F.lit(None).cast("bigint").alias("n_values")))
        else:
            rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(None).cast("double").alias("lower_bound"),
                                 F.lit(None).cast("double").alias("upper_bound"),
                                 F.lit(0).cast("bigint").alias("n_values")))
    base = wide.select(F.inline(F.array(*rows)))
    text_cols = [c for c in cols if not _is_numeric(fields[c])]
    if not text_cols:
        return base.withColumn("possible_values", F.lit(None).cast("string"))
    # distinct values of all text columns in one grouped count; lists only of
    # columns with few values, never a collect of the raw column
    counts = value_counts(df, text_cols)
    seen = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("_n"))
    vals = (counts.join(seen.where(F.col("_n") <= max_values).select("column_name"), "column_name")
            .groupBy("column_name")
            .agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("possible_values")))
    return (base.join(seen, "column_name", "left").withColumn("n_values", F.coalesce("_n", "n_values")).drop("_n")
            .join(vals, "column_name", "left"))
