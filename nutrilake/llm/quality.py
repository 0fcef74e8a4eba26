"""Quality rules as a short-circuit cascade (operator 4).

The rules are measured on a sample: which documents each rejects, and its
seconds after each other rule, since rules share steps. They then run in
descending order of rejections per second, each given those before it, and a document that one
rejects is not shown to the later ones.
Order changes only the work, never the verdict: a document is kept if no
rule rejects it.

Nulls and texts without a word count as empty: all figures are 0 and the
document is rejected as too short. Rows are judged one by one, so ties,
repeated rows and extra columns do not matter; an empty table gives an empty
result. A clashing column name is replaced by the operator's own.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nutrilake.llm.textbytes import Texts, mix64, ngram_hashes, repeated, texts_of

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"): ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a"): ord("z") + 1] = True


class Figures:
    """Figures of a run of documents, each computed when a rule first asks for it."""

    def __init__(self, texts: Texts):
        self.texts = texts

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.texts.words()[2], minlength=self.texts.n)

    @cached_property
    def word_chars(self) -> np.ndarray:
        data = self.texts.data
        spaces = (data == 32) | ((data >= 9) & (data <= 13))
        return self.texts.per_doc(((data & 0xC0) != 0x80) & ~spaces)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.texts.per_doc(_SYMBOL[self.texts.data])

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self.texts.per_doc(_UPPER[self.texts.data])

    @cached_property
    def n_lower(self) -> np.ndarray:
        return self.texts.per_doc(_LOWER[self.texts.data])

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, end, doc = self.texts.lines()
        word_start = self.texts.words()[0]
        has_word = np.searchsorted(word_start, end) > np.searchsorted(word_start, start)
        return start[has_word], end[has_word], doc[has_word]

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self._lines[2], minlength=self.texts.n)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        start, end, doc = self._lines
        key = mix64(self.texts.hash_of(start, end) ^ mix64(doc.astype(np.uint64)))
        return np.bincount(doc[repeated(key)[1]], minlength=self.texts.n)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        start, end, doc = self.texts.words()
        windows, first = ngram_hashes(self.texts.hash_of(start, end), doc, 3)
        twice = first[repeated(mix64(windows ^ mix64(doc[first].astype(np.uint64))))[0]]
        covered = np.zeros(len(doc) + 2, bool)
        for j in range(3):
            covered[twice + j] = True
        return np.bincount(doc[covered[: len(doc)]], minlength=self.texts.n)


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Figures], np.ndarray]


#: The two rules of the base verdict.
BASE_RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
)
#: Further production rules: symbols, repeated lines, odd word lengths, capitals.
RULES: tuple[Rule, ...] = BASE_RULES + (
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("repeated_lines", lambda f: (10 * f.n_dup_lines > 3 * f.n_lines) & (f.n_dup_lines >= 5)),
    Rule("short_words", lambda f: f.word_chars < 2 * f.n_words),
    Rule("long_words", lambda f: f.word_chars > 20 * f.n_words),
    Rule("capitals", lambda f: f.n_upper > f.n_lower),
)
BASE_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rows that a rule's cost and selectivity are estimated on, in expectation.
SAMPLE_ROWS = 1000


def sampled(docs: DataFrame, text: str, sample_rows: int) -> DataFrame:
    """About ``sample_rows`` texts, left where they are."""
    return docs.select(text).where(F.rand(11) < min(1.0, sample_rows / max(1, docs.count())))


def rule_statistics(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text",
                    sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per rule: ``rows`` seen, ``rejected`` rows and ``seconds`` on a sample of about ``sample_rows`` documents, each rule on its own."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(0)):
                for rule in rules:
                    began = time.perf_counter()
                    lost = int(rule.rejects(Figures(Texts(texts.data, texts.off, 0, texts.n))).sum())
                    yield pa.RecordBatch.from_pydict({"rule": [rule.name], "rows": [texts.n], "rejected": [lost],
                                                      "seconds": [time.perf_counter() - began]})

    parts = sampled(docs, text, sample_rows).mapInArrow(measure, "rule string, rows long, rejected long, seconds double")
    return parts.groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("rows", "rejected", "seconds")))


def marginal_costs(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS,
                   have: Sequence[str] = ()) -> tuple[dict[int, int], np.ndarray]:
    """Of about ``sample_rows`` documents: how many each set of rules (as bits) rejects, and the seconds that rule j takes after rule i.

    The figures ``have`` are there before; row ``len(rules)`` is what a rule takes after them alone. Each partition measures its own
    part of the sample, so that no text moves.
    """
    n = len(rules)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(0)):
                def fresh() -> Figures:
                    figures = Figures(Texts(texts.data, texts.off, 0, texts.n))
                    for name in have:
                        getattr(figures, name)
                    return figures
                lost = np.zeros(texts.n, np.int64)
                for j, rule in enumerate(rules):
                    lost |= rule.rejects(fresh()).astype(np.int64) << j
                masks, rows = np.unique(lost, return_counts=True)
                yield pa.RecordBatch.from_pydict({"i": np.full(len(masks), -1), "j": masks, "value": rows.astype(float)})
                for i in range(n + 1):
                    for j, rule in enumerate(rules):
                        if i != j:
                            figures = fresh()
                            if i < n:
                                rules[i].rejects(figures)
                            began = time.perf_counter()
                            rule.rejects(figures)
                            yield pa.RecordBatch.from_pydict({"i": [i], "j": [j], "value": [time.perf_counter() - began]})

    found = sampled(docs, text, sample_rows).mapInArrow(measure, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    seconds = np.zeros((n + 1, n))
    for r in found:
        if r["i"] >= 0:
            seconds[r["i"], r["j"]] = r["value"]
    return {r["j"]: int(r["value"]) for r in found if r["i"] < 0}, seconds


def cascade_order(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS,
                  have: Sequence[str] = ()) -> list[Rule]:
    """The rules by rejections per second on the sample, one after the other.

    The next rule is the one that rejects most of what the rules before it leave, for the seconds that it takes on top of
    them: what it shares with one of them is paid. Rules that reject nothing there keep their given order at the end.
    """
    masks, seconds = marginal_costs(docs, rules, text, sample_rows, have)
    left, order = list(range(len(rules))), []
    while left:
        def gain(j: int) -> float:
            rejected = sum(rows for mask, rows in masks.items() if mask >> j & 1 and not any(mask >> i & 1 for i in order))
            return rejected / max(min(seconds[i, j] for i in [*order, len(rules)]), 1e-9)
        best = max(left, key=lambda j: (gain(j), -j))
        order.append(best)
        left.remove(best)
    return [rules[j] for j in order]


class Alive:
    """Figures of some rows of a batch: those that are there for all rows are picked, the others computed for these rows alone.

    While most rows are alive, figures are computed for all of them, since steps that figures share are there for all.
    """

    def __init__(self, every: Figures, column: pa.Array, lo: int, rows: np.ndarray):
        self._every, self._column, self._lo, self._rows, self._own = every, column, lo, rows, None

    def __getattr__(self, name: str) -> np.ndarray:
        if name in vars(self._every) or 2 * len(self._rows) > self._every.texts.n:
            return getattr(self._every, name)[self._rows]
        if self._own is None:
            self._own = Figures(next(texts_of(self._column.take(pa.array(self._lo + self._rows)), 1 << 62)))
        return getattr(self._own, name)


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", figures: Sequence[str] = (),
            base: Sequence[Rule] = BASE_RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``figures`` of every document, ``base_failed`` (a rule of ``base`` rejects it) and ``kept``.

    With ``figures`` empty and ``base`` empty only the rules that a document reaches are computed for it.
    """
    base_names = {rule.name for rule in base}
    ordered = cascade_order(docs, [r for r in rules if r.name not in base_names], text, sample_rows, figures)
    names = [*figures, "base_failed", "kept"]
    kept_columns = [c for c in docs.columns if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept_columns] + [T.StructField(c, T.LongType()) for c in figures]
                          + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(kept_columns.index(text))
            for texts in texts_of(column):
                seen = Figures(texts)
                own = {c: np.asarray(getattr(seen, c), np.int64) for c in figures}
                failed = np.zeros(texts.n, bool)
                for rule in base:
                    failed |= rule.rejects(seen)
                alive = np.flatnonzero(~failed)
                kept = ~failed
                now = Alive(seen, column, texts.lo, alive)
                for rule in ordered:
                    if not len(alive):
                        break
                    lost = rule.rejects(now)
                    kept[alive[lost]] = False
                    if lost.any():
                        alive = alive[~lost]
                        now = Alive(seen, column, texts.lo, alive)
                out = [batch.column(i).slice(texts.lo, texts.n) for i in range(len(kept_columns))]
                out += [pa.array(own[c]) for c in figures] + [pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(out, names=kept_columns + names)

    return docs.select(*(F.col(f"`{c}`") for c in kept_columns)).mapInArrow(judge, schema)


#: What the production query gives, as DuckDB SQL.
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
flat AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS a FROM w),
tri AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c
        FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM tri WHERE c IS NOT NULL),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM ln
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(dup.n_lines, 0) AS n_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
             length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR (10 * n_dup_lines > 3 * n_lines AND n_dup_lines >= 5) OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR n_upper > n_lower) AS kept
FROM f
"""
