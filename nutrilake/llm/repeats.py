"""Repeated substrings across all texts by an enhanced suffix array (operator 3).

A byte goes if a string of ``length`` bytes that covers it also starts
earlier: in a document with a smaller doc_id, or earlier in its own.

1. Every window of ``length`` bytes has an anchor, the smallest hashed k-gram
   in it; equal windows have equal anchors at equal places. Consecutive
   windows with one anchor make a run, so that a text is covered by about
   2 / (length - k) runs a byte. Runs travel as hashes only.
2. Runs meet at their anchor's hash. A run whose bytes all occurred in an
   earlier run there is a repeat as a whole. Runs that are alone or have
   nothing but equals are done; the first of each kind of run where anchors
   agree but runs differ go on, with their bytes.
3. Those byte strings are sorted into one generalised suffix array a task (all
   suffixes of at least ``length`` bytes) with its longest common prefixes. A
   stack scan of the prefixes walks the tree of common-prefix intervals; an
   interval whose occurrences are preceded by different bytes is a maximal
   repeat, given with all its occurrences. All but the first are marked.
4. Marks meet their document, whose remaining bytes are joined.

Equal windows always share their anchor, so no repeat crosses step 2's
groups. A group is combined in every batch before it is shuffled; where a
group is large (LARGE_GROUP runs), its windows are grouped by their own hash
instead, and equal windows are combined in every batch too, so that no task
gets what grows with a passage's number of copies.

Null and empty texts, and texts shorter than ``length``, keep all bytes; null
counts as empty. Rows with equal doc_id and text are one document with one
result; rows with equal doc_id and different texts are ordered by a hash of
the text, and rows without a doc_id come last, likewise ordered. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nutrilake.llm.mixing import running_start
from nutrilake.llm.textbytes import U64, Texts, mix64, texts_of
from nutrilake.session import materialize

LENGTH, GRAM = 100, 32
#: Runs of an anchor in one batch, and in all, from which on its windows are grouped by their own hashes.
LARGE_IN_BATCH, LARGE_GROUP = 16, 20_000
#: Byte strings that one suffix array is built over, about.
ARRAY_STRINGS = 2000
#: A run in one number: start * 1024 + windows * 8 + large * 4 + how (0: to be met, 1: a repeat, 2: to be sorted).
RUN_SHIFT, COUNT_SHIFT = 10, 3


def window_anchors(texts: Texts, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows within a document, and the place of each one's anchor."""
    n = len(texts.data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(texts.data) - gram + 1)
    # Smallest hash, then leftmost.
    low = (texts.hash_of(at, at + gram) & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    span, have = length - gram + 1, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have:])
    inside = np.ones(n, bool)
    for end in texts.off[1:-1]:
        inside[max(0, end - length + 1): end] = False
    start = np.flatnonzero(inside)
    return start, (low[start] & U64(0xFFFFFFFF)).astype(np.int64)


def runs_of(texts: Texts, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Document, start in it, number of windows, anchor hash and 48-bit hash of the bytes of every run."""
    start, anchor = window_anchors(texts, length, gram)
    if not len(start):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, U64), np.zeros(0, U64)
    first = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1])]))
    # A window that starts right after another document's last one is a run of its own.
    doc = texts.doc_of(start[first])
    count = np.diff(np.concatenate([first, [len(start)]]))
    lo, at = start[first], anchor[first]
    meet = texts.hash_of(at, at + gram)
    with np.errstate(over="ignore"):
        kind = mix64(texts.hash_of(lo, lo + count - 1 + length) + (at - lo).astype(U64)) >> U64(16)
    return doc, lo - texts.off[doc], count, meet, kind


def run_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``meet``, ``kind``, ``doc``, ``run``: every run once, combined within batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for texts in texts_of(batch.column(1), 1_000_000):
                doc, start, count, meet, kind = runs_of(texts, length, gram)
                if not len(doc):
                    continue
                name = ids[texts.lo + doc]
                order = np.lexsort((start, name, kind, meet))
                name, start, count, meet, kind = (v[order] for v in (name, start, count, meet, kind))
                # Equal rows are one document: their runs are no repeats of one another.
                first = np.concatenate([[True], (meet[1:] != meet[:-1]) | (kind[1:] != kind[:-1]) | (name[1:] != name[:-1]) | (start[1:] != start[:-1])])
                name, start, count, meet, kind = (v[first] for v in (name, start, count, meet, kind))
                new_meet = np.concatenate([[True], meet[1:] != meet[:-1]])
                new_kind = new_meet | np.concatenate([[True], kind[1:] != kind[:-1]])
                # The number of each run's kind within its anchor.
                kinds = np.cumsum(new_kind)
                number = kinds - kinds[np.maximum.accumulate(np.where(new_meet, np.arange(len(meet)), 0))]
                group = np.cumsum(new_meet) - 1
                large = (np.bincount(group, new_kind) > LARGE_IN_BATCH)[group]
                how = np.where(~new_kind, 1, np.where(large & (number > 0), 2, 0))
                alone = mix64(meet ^ mix64(name.astype(np.int64).view(U64) ^ mix64(start.astype(U64))))
                yield pa.RecordBatch.from_pydict({
                    "meet": np.where(how == 0, meet, alone).view(np.int64), "kind": kind.view(np.int64), "doc": name.astype(np.int64),
                    "run": (start << RUN_SHIFT) + (count << COUNT_SHIFT) + large * 4 + how})

    return docs.mapInArrow(run, "meet long, kind long, doc long, run long")


def judged_runs(runs: DataFrame) -> DataFrame:
    """``doc``, ``run``, ``meet`` and ``large`` of the runs that are repeats (``how`` 1) or must be sorted (``how`` 2)."""
    here = Window.partitionBy("meet")
    earlier = Window.partitionBy("meet", "kind").orderBy("doc", "run")
    # A run of an equal row in another batch is the same run; its low bits may differ, a repeat's sort first.
    place = F.struct("doc", F.shiftright("run", COUNT_SHIFT).alias("at"))
    how, large = F.col("run").bitwiseAND(3), F.col("run").bitwiseAND(4) > 0
    seen = runs.select("*", F.lag(place).over(earlier).eqNullSafe(place).alias("again"), (F.first(place).over(earlier) != place).alias("repeat"), ((F.min("kind").over(here) != F.max("kind").over(here)) | F.max(large).over(here)).alias("mixed"),
                       (F.max(large).over(here) | (F.count("*").over(here) > LARGE_GROUP)).alias("large"))
    verdict = F.when((how == 1) | F.col("repeat"), 1).when((how == 2) | F.col("mixed"), 2)
    return seen.where(~F.col("again")).select("doc", "run", "meet", "large", verdict.alias("how")).where(F.col("how").isNotNull())


def packed_texts(rows: DataFrame) -> DataFrame:
    """``doc``, ``doc_id``, ``n_bytes`` and ``packed``, the text's bytes compressed for the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(2)):
                raw = [texts.data[a:b].tobytes() for a, b in zip(texts.off[:-1], texts.off[1:])]
                packed = pa.array([pa.compress(r, "zstd", asbytes=True) if r else b"" for r in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(texts.lo, texts.n) for i in range(2)), pa.array(np.diff(texts.off)), packed],
                                                 names=["doc", "doc_id", "n_bytes", "packed"])

    return rows.mapInArrow(run, "doc long, doc_id long, n_bytes long, packed binary")


def unpacked(packed: bytes, n_bytes: int) -> bytes:
    return pa.decompress(packed, n_bytes, "zstd", asbytes=True) if n_bytes else b""


def strings_to_sort(joined: DataFrame, length: int) -> DataFrame:
    """``key``, ``bytes``, ``doc``, ``start``: the bytes of runs by anchor, or single windows by their own hash where the anchor is large.

    Windows that repeat within a batch come with null bytes: they are marks already.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, data, name, at = [], [], [], []
            singles, done = [], set()
            for doc, n_bytes, packed, runs in zip(*(batch.column(i) for i in (0, 2, 3, 4))):
                text, d = unpacked(packed.as_py(), n_bytes.as_py()) if runs.is_valid and len(runs) else b"", doc.as_py()
                if d in done:  # an equal row
                    continue
                done.add(d)
                for one in runs.as_py() or ():
                    start, count = one["run"] >> RUN_SHIFT, (one["run"] >> COUNT_SHIFT) & 127
                    if one["large"]:
                        singles += [(text[s: s + length], d, s) for s in range(start, start + count)]
                    else:
                        key.append(one["meet"])
                        data.append(text[start: start + count - 1 + length])
                        name.append(d)
                        at.append(start)
            singles = sorted(set(singles))  # a run can come by its anchor and alone
            before = None
            for window, d, s in singles:
                again = window == before
                key.append(int.from_bytes(hashlib.blake2b(window if not again else f"{d}:{s}".encode(), digest_size=8).digest(), "little", signed=True))
                data.append(None if again else window)
                name.append(d)
                at.append(s)
                before = window
            yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "bytes": pa.array(data, pa.binary()),
                                              "doc": pa.array(name, pa.int64()), "start": pa.array(at, pa.int64())})

    return joined.mapInArrow(run, "key long, bytes binary, doc long, start long")


class SuffixArray:
    """All suffixes of at least ``length`` bytes of the strings, sorted, with the common prefix of each and the one before."""

    def __init__(self, strings: list[bytes], length: int):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.width = width = int(sizes.max())
        self.base = np.cumsum(sizes + width) - (sizes + width)  # each string is followed by zeros
        self.data = np.frombuffer(b"".join(s + bytes(width) for s in strings), np.uint8)
        many = np.maximum(sizes - length + 1, 0)
        string = np.repeat(np.arange(len(strings)), many)
        offset = np.arange(len(string)) - np.repeat(np.cumsum(many) - many, many)
        rows = np.lib.stride_tricks.sliding_window_view(self.data, width)[self.base[string] + offset]
        order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
        self.string, self.offset, rows = string[order], offset[order], rows[order]
        left = sizes[self.string] - self.offset
        differ = rows[1:] != rows[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        self.common = np.concatenate([[0], np.minimum(common, np.minimum(left[1:], left[:-1]))]) if len(rows) else np.zeros(0, np.int64)
        # The byte before each suffix; a string's own start is preceded by something unknown.
        self.before = np.where(self.offset > 0, self.data[self.base[self.string] + self.offset - 1].astype(np.int64), -1)

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(common prefix, first, last + 1) of each interval of the array with a prefix of ``least`` bytes or more whose occurrences
        are preceded by different bytes; -1 before an occurrence counts as different from all."""
        deep = self.common >= least
        starts = np.flatnonzero(deep & ~np.concatenate([[False], deep[:-1]])) - 1
        ends = np.flatnonzero(deep & ~np.concatenate([deep[1:], [False]])) + 1
        for lo, hi in zip(starts.tolist(), ends.tolist()):
            common, before = self.common[lo:hi].tolist(), self.before[lo:hi].tolist()
            stack: list[list[int]] = []  # [common prefix, first, byte before or -1 for several]
            for i in range(1, hi - lo + 1):
                now = common[i] if i < hi - lo else 0
                first, seen = i - 1, before[i - 1]
                while stack and stack[-1][0] > now:
                    depth, first, byte = stack.pop()
                    byte = byte if byte == seen else -1
                    if byte < 0:
                        yield depth, lo + first, lo + i
                    seen = byte
                if now >= least:
                    if stack and stack[-1][0] == now:
                        if stack[-1][2] != seen:
                            stack[-1][2] = -1
                    else:
                        stack.append([now, first, seen])


def marks_of(strings: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of what the strings repeat of one another: all occurrences of a maximal repeat but the first."""
    array = SuffixArray(strings, length)
    order = np.lexsort((start[array.string] + array.offset, doc[array.string]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    change = np.zeros(len(array.data) + 1, np.int64)
    at = array.base[array.string] + array.offset if len(order) else order
    for depth, lo, hi in array.maximal_repeats(length):
        first = lo + int(place[lo:hi].argmin())
        for i in range(lo, hi):
            if i != first:
                change[at[i]] += 1
                change[at[i] + depth] -= 1
    covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    lo, hi = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(~covered[1:] & covered[:-1])
    which = np.searchsorted(array.base, lo, side="right") - 1
    return doc[which], start[which] + lo - array.base[which], start[which] + hi - array.base[which]


def sorted_marks(strings: DataFrame, length: int) -> DataFrame:
    """``doc``, ``lo``, ``hi``: what the strings of a key repeat of one another."""
    dealt = strings.repartition("key").sortWithinPartitions("key", "bytes", "doc", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[bytes, int, int]] = []
        last, waiting = None, []

        def rows(parts: list[tuple]) -> pa.RecordBatch:
            doc, lo, hi = (np.concatenate([np.asarray(p[i], np.int64) for p in parts] or [np.zeros(0, np.int64)]) for i in range(3))
            return pa.RecordBatch.from_pydict({"doc": doc, "lo": lo, "hi": hi})

        def sort() -> tuple:
            return marks_of([k[0] for k in kept], np.array([k[1] for k in kept]), np.array([k[2] for k in kept]), length)

        for batch in batches:
            found = []
            for key, data, doc, start in zip(*(c.to_pylist() for c in batch.columns)):
                if data is None:
                    waiting.append((doc, start, start + length))
                    continue
                if last is not None and last[0] == key and last[1] == data:
                    if kept[-1][1:] != (doc, start):  # equal to the string before, which is earlier
                        waiting.append((doc, start, start + len(data)))
                    continue
                if len(kept) >= ARRAY_STRINGS and last[0] != key:
                    found.append(sort())
                    kept.clear()
                kept.append((data, doc, start))
                last = key, data
            if waiting:
                found.append(tuple(zip(*waiting)))
                waiting = []
            yield rows(found)
        if kept:
            yield rows([sort()])

    return dealt.mapInArrow(run, "doc long, lo long, hi long")


def in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc`` (a number that follows the documents' order), ``doc_id`` and ``text``.

    ``doc`` is the doc_id itself unless a doc_id is missing or has several texts.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    several = rows.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")) \
        .where("doc_id is null or a != b")
    if several.isEmpty():
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    names = rows.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("t")).distinct()
    dealt = materialize(names.repartitionByRange(256, F.col("i").isNull(), "i", "t").withColumn("_part", F.spark_partition_id()))
    start = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", running_start("_n"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("i").asc_nulls_last(), "t")).cast("bigint")
    numbered = dealt.join(F.broadcast(start), "_part").select("i", "t", (own + F.col("_start")).alias("doc"))
    return rows.withColumn("h", F.xxhash64("text")) \
        .join(numbered, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("t"))).select("doc", "doc_id", "text")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text",
                   with_text: bool = False) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked for, ``kept`` (the remaining bytes) of every row."""
    rows = in_order(docs, doc_id, text)
    texts = rows.select("doc", "text")
    judged = judged_runs(run_table(texts, length, gram))
    found = materialize(judged.groupBy("doc").agg(F.collect_list(F.when(F.col("how") == 1, F.col("run"))).alias("repeats"),
                                                  F.collect_list(F.when(F.col("how") == 2, F.struct("run", "meet", "large"))).alias("runs")))
    # Both joins take the same columns of the texts, so that these are shuffled once.
    columns = ["doc", "doc_id", "n_bytes", "packed"]
    packed = packed_texts(rows)
    # Equal rows give equal strings, of which all but one are dropped again.
    strings = strings_to_sort(packed.join(found.select("doc", "runs"), "doc", "left").select(*columns, "runs"), length)
    marks = sorted_marks(strings, length).where("lo < hi").groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ("n_removed", "n_spans", "kept_sha256", "kept")}
            n_bytes = batch.column(1).to_pylist()
            for size, packed_text, lists, whole in zip(n_bytes, *(batch.column(i) for i in (2, 3, 4))):
                raw = unpacked(packed_text.as_py(), size)
                removed = spans = 0
                if (lists.is_valid and len(lists)) or (whole.is_valid and len(whole)):
                    change = np.zeros(size + 1, np.int64)
                    if lists.is_valid:
                        np.add.at(change, np.asarray(lists.values.field("lo")), 1)
                        np.add.at(change, np.asarray(lists.values.field("hi")), -1)
                    if whole.is_valid:
                        runs = np.asarray(whole.values)
                        lo = runs >> RUN_SHIFT
                        np.add.at(change, lo, 1)
                        np.add.at(change, lo + ((runs >> COUNT_SHIFT) & 127) - 1 + length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed, spans = int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                for c, v in zip(out, (removed, spans, hashlib.sha256(raw).hexdigest(), raw if with_text else None)):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()),
                 pa.array(out["kept_sha256"], pa.string()), *([pa.array(out["kept"], pa.binary())] if with_text else [])],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    final = packed.join(marks, "doc", "left").join(found.select("doc", "repeats"), "doc", "left") \
        .select("doc_id", "n_bytes", "packed", "marks", "repeats")
    return final.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))
