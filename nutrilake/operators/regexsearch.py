"""Regular-expression name search in bulk (P9): patterns against a table of texts, first n matches each.

A pattern is matched anywhere in the text and without regard to case, by
Python's ``re``. To avoid a scan of all texts for each pattern, its parse tree
gives literals that every match must hold: clauses of alternatives, of
which one each must occur. The cheapest clause, by the number of texts that
hold the rarest gram of each alternative, gives the candidates by a
join on grams; the pattern itself is then tried on these.

Patterns without any literal (such as ``\\d+``) are tried on all texts, blocks of
patterns at a time. A pattern that does not compile matches nothing.

Texts are folded before they are indexed: lower case, and the letters that ignoring case
makes equal to i and s. Other literals than ASCII letters, digits and common signs end a literal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from re import _constants as ops
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nutrilake.operators.lookup import GRAM, gram_index
from nutrilake.session import materialize

#: Strings that a part of a pattern is spelled out to, at most; patterns without a literal that one row of texts meets together.
SPELLED, PATTERN_BLOCK = 16, 256

Clause = tuple[str, ...]


def folded(text: Column) -> Column:
    return F.translate(F.lower(F.translate(text, "İ", "i")), "ıſ", "is")


def _spelled(items) -> tuple[set[str] | None, list[Clause]]:
    """A part of a parse tree: all strings that it matches (None if it cannot be spelled out), and the clauses that every match meets."""
    run: set[str] = {""}
    clauses: list[Clause] = []
    whole = True

    def end_run() -> None:
        nonlocal run, whole
        if all(run):
            clauses.append(tuple(sorted(run)))
        run, whole = {""}, False

    for op, value in items:
        strings, inner = _one(op, value)
        clauses.extend(inner)
        if strings is None:
            end_run()
        elif len(run) * len(strings) <= SPELLED:
            run = {a + b for a in run for b in strings}
        else:
            end_run()
            run = strings
    if whole:
        return run, clauses
    end_run()
    return None, clauses


def _one(op, value) -> tuple[set[str] | None, list[Clause]]:
    if op is ops.LITERAL:
        c = chr(value).lower()
        return ({c}, []) if 0x20 <= value < 0x7F else (None, [])
    if op is ops.IN:
        if all(kind is ops.LITERAL and 0x20 <= c < 0x7F for kind, c in value) and len(value) <= SPELLED:
            return {chr(c).lower() for _, c in value}, []
        return None, []
    if op is ops.AT:
        return {""}, []
    if op is ops.SUBPATTERN:
        return _spelled(value[3])
    if op is ops.BRANCH:
        parts = [_spelled(p) for p in value[1]]
        strings = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
        if strings is not None and len(strings) <= SPELLED:
            return strings, []
        # One clause of each alternative, the one with the longest shortest string; none if an alternative has none.
        own = [([tuple(sorted(s))] if s and all(s) else []) + c for s, c in parts]
        return None, [tuple(sorted({x for c in own for x in max(c, key=lambda c: min(map(len, c)))}))] if all(own) else []
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
        least, most, part = value
        strings, inner = _spelled(part)
        if strings is not None and (least, most) in ((0, 1), (1, 1)) and len(strings) < SPELLED:
            return strings | ({""} if least == 0 else set()), []
        clause = [tuple(sorted(strings))] if strings and all(strings) else []
        return None, [*inner, *clause] if least else []
    return None, []


@lru_cache(maxsize=10_000)
def compiled(pattern: str) -> re.Pattern | None:
    try:
        return re.compile(pattern, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError):
        return None


def required_literals(pattern: str) -> list[Clause]:
    """Clauses of literals in lower case: of each, one must occur in every (folded) match. Empty if there are none."""
    if (found := compiled(pattern)) is None or not found.flags & re.IGNORECASE or found.flags & re.VERBOSE:
        return []
    strings, clauses = _spelled(_parser.parse(pattern, re.IGNORECASE))
    return ([tuple(sorted(strings))] if strings and all(strings) else []) + clauses


def _grams(text: str) -> list[str]:
    size = min(GRAM, len(text))
    return sorted({text[i: i + size] for i in range(len(text) - size + 1)})


def pattern_grams(patterns: DataFrame) -> DataFrame:
    """(pattern, clause, alternative, gram) of the distinct ``pattern``; one row with null gram for those without a literal."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pattern in batch.column(0).to_pylist():
                if compiled(pattern) is not None:
                    clauses = required_literals(pattern)
                    rows += [(pattern, i, j, g) for i, clause in enumerate(clauses) for j, s in enumerate(clause) for g in _grams(s)] or [(pattern, 0, 0, None)]
            yield pa.RecordBatch.from_pylist([dict(zip(("pattern", "clause", "alternative", "gram"), r)) for r in rows],
                                             pa.schema([("pattern", pa.string()), ("clause", pa.int32()), ("alternative", pa.int32()), ("gram", pa.string())]))
    return patterns.mapInArrow(run, "pattern string, clause int, alternative int, gram string")


def _tried(rows: DataFrame) -> DataFrame:
    """Those of (pattern, _key, text) whose text the pattern matches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [p is not None and p.search(t) is not None for p, t in zip(map(compiled, batch.column(0).to_pylist()), batch.column(2).to_pylist())]
            yield batch.filter(pa.array(hit, pa.bool_())).select(["pattern", "_key"])
    return rows.select("pattern", "_key", "text").mapInArrow(run, f"pattern string, _key {dict(rows.dtypes)['_key']}")


def _tried_in_blocks(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, _key) of patterns without a literal: every text meets each block of patterns once."""
    n = patterns.count()
    blocks = -(-n // PATTERN_BLOCK)
    if not blocks:
        return texts.select(F.lit("").alias("pattern"), "_key").limit(0)
    block = patterns.groupBy(F.pmod(F.xxhash64("pattern"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("pattern").alias("patterns"))
    met = texts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(block, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(p, k) for k, t, ps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()) for p in ps if compiled(p).search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([k for _, k in out], batch.schema.field(0).type)], names=["pattern", "_key"])
    return met.select("_key", "text", "patterns").mapInArrow(run, f"pattern string, _key {dict(texts.dtypes)['_key']}")


def candidates(planned: DataFrame, index: DataFrame) -> DataFrame:
    """(pattern, _key) that hold a gram of the cheapest clause of the pattern."""
    frequency = index.groupBy("gram").agg(F.count("*").alias("df"))
    rarest = planned.where(F.col("gram").isNotNull()).join(frequency, "gram", "left") \
        .groupBy("pattern", "clause", "alternative").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("best"))
    cheapest = rarest.groupBy("pattern", "clause").agg(F.sum("best.df").alias("cost"), F.collect_set("best.gram").alias("grams")) \
        .groupBy("pattern").agg(F.min(F.struct("cost", "clause", "grams")).alias("c"))
    return cheapest.select("pattern", F.explode("c.grams").alias("gram")).join(index.select("gram", "_key"), "gram").select("pattern", "_key").distinct()


def regex_matches(requests: DataFrame, request_id: str, pattern: str, texts: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """First ``n`` texts (by ``key``) that each request's pattern matches: (request_id, key, pos), pos = 1..n. Null texts match nothing."""
    asked = requests.select(F.col(request_id).alias("_qid"), F.col(pattern).alias("pattern")).where(F.col("pattern").isNotNull())
    held = texts.select(F.col(key).alias("_key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    index = materialize(gram_index(held.withColumn("_f", folded(F.col("text"))), "_key", "_f").select("gram", "_key"))
    planned = materialize(pattern_grams(asked.select("pattern").distinct()))
    found = _tried(candidates(planned, index).join(held, "_key")) \
        .unionByName(_tried_in_blocks(planned.where(F.col("gram").isNull()).select("pattern"), held))
    order = Window.partitionBy("pattern").orderBy("_key")
    first = found.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n)
    return asked.join(first, "pattern").select(F.col("_qid").alias(request_id), F.col("_key").alias(key), "pos")
