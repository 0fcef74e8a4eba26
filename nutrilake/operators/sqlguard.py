"""Read-only SQL over registered views.

``safe_select`` accepts only statements starting with SELECT (trimmed, any
case); anything else, and any analysis error, gives a one-row DataFrame
``(error string)``. Values are passed as named parameter markers, never
pasted into the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

READ_ONLY_ERROR = "Seules les requetes SELECT sont autorisees."


def safe_select(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    if not sql.strip().lower().startswith("select"):
        return spark.createDataFrame([(READ_ONLY_ERROR,)], "error string")
    try:
        df = spark.sql(sql.strip(), args=args or {})
        df.schema  # analysis happens here: unknown tables or columns raise
        return df
    except Exception as exc:  # AnalysisException, ParseException
        return spark.createDataFrame([(str(exc),)], "error string")
