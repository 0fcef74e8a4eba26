"""Cleaning flow operators: column filter (P1), null-safe row filter (P2) and
the product x distributor expansion (J1)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 19 columns kept by the cleaning flow, with '-' spelled '_'.
CLEAN_COLUMNS = [
    "product_name", "brands_tags", "categories_en", "countries_en", "ingredients_text", "states_en",
    "energy_100g", "fat_100g", "saturated_fat_100g", "carbohydrates_100g", "sugars_100g", "fiber_100g",
    "proteins_100g", "salt_100g", "sodium_100g", "calcium_100g", "iron_100g", "code",
    "nutrition_score_fr_100g",
]


def column_filter(df: DataFrame, include: Sequence[str] = CLEAN_COLUMNS,
                  keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Keep the include list in its order; listed columns that do not
    exist are ignored and unlisted ones dropped. ``keep`` carries the row key."""
    present = set(df.columns)
    cols = [c for c in keep if c in present] + [c for c in include if c in present and c not in keep]
    return df.select(*cols)


def invalid_product(df: DataFrame) -> Column:
    """The eight drop conditions of the cleaning flow, OR-ed null-safely."""
    checks: list[Column] = []
    for c in ("product_name", "nutrition_score_fr_100g", "brands_tags", "categories_en"):
        if c in df.columns:
            checks.append(F.col(c).isNull())
    if "sugars_100g" in df.columns:
        checks.append(F.col("sugars_100g") > 100)
        checks.append(F.col("sugars_100g") < 0)
    for c in ("salt_100g", "sodium_100g"):
        if c in df.columns:
            checks.append(F.col(c) >= 100)
    return any_true(checks)


def any_true(conditions: Iterable[Column]) -> Column:
    """OR of predicates where an unknown (null) predicate counts as false."""
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def row_filter_non_matching(df: DataFrame, conditions: Column | None = None) -> DataFrame:
    """Keep the rows for which no drop condition holds."""
    cond = invalid_product(df) if conditions is None else conditions
    return df.where(~cond)


def clean_products(products: DataFrame) -> DataFrame:
    return row_filter_non_matching(column_filter(products))


def expand_by_dimension(df: DataFrame, rows: Sequence[tuple], names: Sequence[str],
                        suffix: str = " (#1)") -> DataFrame:
    """Every row paired with every row of a small literal dimension.

    The dimension is a fixed literal list, so the pairing is a generator
    (``explode`` of a literal array) inside the scan stage: no join, no
    shuffle, linear in the input. Right-side names that clash get ``suffix``.
    """
    out_names = [n + suffix if n in df.columns else n for n in names]
    arr = F.array(*[
        F.struct(*[F.lit(v).alias(n) for v, n in zip(row, out_names)]) for row in rows
    ])
    return df.select("*", F.inline(arr))
