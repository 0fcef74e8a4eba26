"""Replacing what a job reads or others read: staged writes and a swap by rename.

A new version is written whole into a staging folder (or table) beside the
old one; only then is the old one renamed away and the new one renamed into its
place. A job that dies leaves either the old version, or the old one
under its second name, which the next reader or writer puts back. Renames
go through the file system that Spark itself uses for the path; where renames of folders are
not atomic (object stores), use a catalog table of a format that is.

Two jobs that replace one path at the same time are not supported.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import types as T

#: Second name of the version that is being replaced.
OLD = "__old"


def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, where = _fs(spark, path)
    if not fs.rename(where, _fs(spark, to)[1]):
        raise OSError(f"could not rename {path} to {to}")


def recover(spark: SparkSession, path: str) -> None:
    """Ends a replacement that was cut short: back to the old version, or only its removal is left."""
    old = path + OLD
    if exists(spark, old):
        if exists(spark, path):
            delete(spark, old)
        else:
            rename(spark, old, path)


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """``write(folder)`` writes the new version, which may be computed from the one at ``path``; then it takes its place."""
    path = path.rstrip("/")
    recover(spark, path)
    staging = f"{path}__staging-{uuid.uuid4().hex}"
    try:
        write(staging)
    except BaseException:
        delete(spark, staging)
        raise
    if exists(spark, path):
        rename(spark, path, path + OLD)
    rename(spark, staging, path)
    delete(spark, path + OLD)
    return path


def _csv(writer: DataFrameWriter) -> DataFrameWriter:
    return writer.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)


def replace_csv(df: DataFrame, path: str) -> str:
    """The table as headed CSV at ``path``, also where ``df`` reads ``path``. Empty strings are read back as null, as CSV holds no nulls of its own."""
    return replace(df.sparkSession, path, lambda folder: _csv(df.write).csv(folder))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What ``replace_csv`` wrote; a replacement that was cut short is ended first. Values may hold line breaks."""
    recover(spark, path.rstrip("/"))
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True) \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def recover_table(spark: SparkSession, table: str) -> None:
    if spark.catalog.tableExists(table + OLD):
        if spark.catalog.tableExists(table):
            spark.sql(f"DROP TABLE {table + OLD}")
        else:
            spark.sql(f"ALTER TABLE {table + OLD} RENAME TO {table}")


def materialize_table(spark: SparkSession, table: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The saved table if it exists, else (or when forced) ``make()`` saved under its name.

    Readers see the old version until the new one is complete; if ``make`` or its write fails, the old version stays.
    """
    recover_table(spark, table)
    if not force and spark.catalog.tableExists(table):
        return spark.table(table)
    staging = f"{table}__staging_{uuid.uuid4().hex}"
    try:
        make().write.saveAsTable(staging)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {staging}")
        raise
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} RENAME TO {table + OLD}")
    spark.sql(f"ALTER TABLE {staging} RENAME TO {table}")
    spark.sql(f"DROP TABLE IF EXISTS {table + OLD}")
    return spark.table(table)
