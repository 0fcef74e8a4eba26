"""File sources and sinks (S1-S5, S7; S8 and S9 are in ``staged``).

CSV/TSV scans use explicit schemas (no inference pass) and keep a ``row_id``
for "file order" operations; sinks never overwrite their own input.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nutrilake.session import shared_path


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
             header: bool = True, drop_malformed: bool = False, row_id: str | None = "row_id") -> DataFrame:
    """CSV scan with a fixed schema; ``row_id`` = position in the scan. Quotes inside values are doubled."""
    r = spark.read.schema(schema).option("header", header).option("sep", sep).option("escape", '"')
    if drop_malformed:
        r = r.option("mode", "DROPMALFORMED")
    rows = r.csv(path)
    return rows.withColumn(row_id, F.monotonically_increasing_id()) if row_id else rows


def read_reference_tsv(spark: SparkSession, path: str, all_columns: Sequence[str], keep: Sequence[str],
                       key: str | None = None) -> DataFrame:
    """S3: tab-separated dump, only ``keep`` columns as strings. Lines with too
    many fields are skipped; a short line keeps its fields, the others are
    null. Column pruning in the CSV parser is switched off for this scan so
    that a wrong field count is seen; only such lines are counted again."""
    bad, sep = "_wrong_line", "\t"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*all_columns, bad]])
    df = (spark.read.schema(schema).option("sep", sep).option("header", True).option("columnPruning", False)
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).csv(path))
    # Separators inside quotes do not count. A right line is one field here: its
    # first column, as Spark does not read the wrong lines' column alone.
    bare = F.coalesce(F.regexp_replace(bad, r'"(?:[^"\\]|\\.)*"', ""), F.replace(F.col(all_columns[0]), F.lit(sep)), F.lit(""))
    cols = ([key] if key else []) + [c for c in keep if c != key]
    return df.where(F.size(F.split(bare, sep)) <= len(all_columns)).select(*cols)


def valid_reference(df: DataFrame, name: str, target: str) -> DataFrame:
    """P3 + F30: both columns present and non-empty (no trim); name lower-cased."""
    return (df.where(F.col(name).isNotNull() & F.col(target).isNotNull()
                     & (F.length(name) > 0) & (F.length(target) > 0))
            .withColumn(name, F.lower(F.col(name))))


def write_tsv_dump(df: DataFrame, name: str, spark: SparkSession) -> str:
    """Write a table as a headed TSV folder in the shared folder; returns the path."""
    path = shared_path(spark, "tables", f"{name}-{uuid.uuid4().hex[:12]}")
    (df.write.mode("errorifexists").option("sep", "\t").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_csv_strings_quoted(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``,`` separator, header, ``"`` quote doubled inside values, only
    string columns quoted, missing -> empty field, fail if the path exists.
    Lines are built with column expressions and written as text; every part
    file begins with the header, as readers take the first line of each."""
    fields = df.schema.fields

    def cell(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            return F.when(c.isNull(), F.lit("")).otherwise(
                F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))
        return F.coalesce(c.cast("string"), F.lit(""))
    header = ",".join('"' + f.name.replace('"', '""') + '"' for f in fields)
    body = df.select(F.concat_ws(",", *[cell(f) for f in fields]).alias("value"))

    def with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(batches):
            if not i:
                yield pa.RecordBatch.from_arrays([pa.array([header])], schema=batch.schema)
            yield batch

    if body.isEmpty():
        body = df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1)
    else:
        body = body.mapInArrow(with_header, "value string")
    body.write.mode(mode).text(path)


def bounded_scan(df: DataFrame, n: int | None = None, key: str = "row_id") -> DataFrame:
    """The first ``n`` rows in file order; unbounded by default."""
    return df if n is None else df.orderBy(key).limit(n)


def fill_missing_text(df: DataFrame, value: str = "") -> DataFrame:
    """Nulls of string columns -> ``value``; numeric columns keep their
    nulls (an empty string in a numeric column would break sorting)."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.na.fill(value, subset=text) if text else df
