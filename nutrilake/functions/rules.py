"""Rule column (F29, U3): ordered ``condition => value`` rules, first match wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rule_engine(rules: Sequence[tuple[Column | str, object]], default: object = None) -> Column:
    """Each condition is a Column or a SQL predicate string; a null
    condition does not match (CASE WHEN semantics)."""
    out = None
    for cond, value in rules:
        c = F.expr(cond) if isinstance(cond, str) else cond
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(c, v) if out is None else out.when(c, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return d if out is None else out.otherwise(d)


def ok_diff(actual: Column, predicted: Column) -> Column:
    """``actual = predicted => "OK"``, ``TRUE => "DIFF"``; a null side is DIFF."""
    return rule_engine([(actual == predicted, "OK")], "DIFF")
