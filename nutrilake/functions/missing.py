"""The four notions of "missing" used by the reference, kept apart on purpose.

1. SQL null (``is_null``).
2. null or blank after trim (``is_blank``).
3. null, blank, or the words nan/null/none in any case (``is_missing_word``).
4. null or exactly one of "", "null", "None" - no trim, no case folding, and
   "nan" is a value (``is_missing_exact``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of missing text.
MISSING_WORDS = ["nan", "", "null", "none"]
MISSING_EXACT = ["", "null", "None"]
MISSING_MARK = "[DONNEE MANQUANTE]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_null(c: Column | str) -> Column:
    return _c(c).isNull()


def is_blank(c: Column | str) -> Column:
    x = _c(c)
    return x.isNull() | (F.trim(x.cast("string")) == "")


def is_missing_word(c: Column | str) -> Column:
    x = _c(c).cast("string")
    return x.isNull() | F.lower(F.trim(x)).isin(MISSING_WORDS)


def is_missing_exact(c: Column | str) -> Column:
    x = _c(c).cast("string")
    return x.isNull() | x.isin(MISSING_EXACT)


def safe_value(c: Column | str) -> Column:
    """missing (notion 3, NaN included) -> ``[DONNEE MANQUANTE]``, else text."""
    x = _c(c)
    return F.when(is_missing_word(x), F.lit(MISSING_MARK)).otherwise(x.cast("string"))


def first_value(*cols: Column | str) -> Column:
    """first value that is not missing in the sense of notion 4."""
    return F.coalesce(*[F.when(~is_missing_exact(c), _c(c)) for c in cols])


def first_number(*cols: Column | str) -> Column:
    """F8: first value, not missing (notion 4), that reads as a number.
    Text "nan" reads as NaN, like Python's float()."""
    return F.coalesce(*[F.when(~is_missing_exact(c), _c(c).try_cast("double")) for c in cols])
