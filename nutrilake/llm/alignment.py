"""Alignment of two tokenizers by lockstep vectorised merging (operator 13).

Both tokenizers cut the same bytes, a space and the text. A batch of
documents is merged in lockstep: one NumPy state vector holds each
document's place in its A tokens and in its B tokens; every step compares the
ends of the two tokens at all places, moves the side that ends first (both,
where they end together, which is a cut), and leaves out documents that are
finished. Two tokens are linked if no cut lies between them, that is if they
are in one group.

A text is tokenized run by run: a run starts at a space that follows a
character which is no white space. Tokens of neither tokenizer reach over such a place (checked
for the vocabularies when they are loaded; the patterns of byte-level BPE
start a match there), so the ids of a run are kept for later texts, within a
bound in bytes, and a long document is merged as several lanes that start at runs.

Corpus-wide counts of id pairs never move a row for each document and pair.
Documents are gathered in units of bounded size; a unit lists its different
pairs with their number of documents. Those lists are added up, give the
highest count of each A id, and go back to their units, where the sums of
each document are taken.

Null and empty texts, and texts that one of the tokenizers does not give back
byte by byte, have no tokens. Repeated rows (equal in id and text) are
documents of their own, each counted. Rows without a doc_id are aligned and
counted like others. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nutrilake.llm import flatfiles
from nutrilake.llm.bpe import byte_characters

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are merged together, tokens of a lane, and entries (documents and different pairs) of a unit.
BATCH_BYTES, LANE_TOKENS, UNIT_ENTRIES = 2_000_000, 2_000, 1_500_000
#: Bytes of runs and tokens that a worker keeps from batch to batch.
KEPT_BYTES = 128_000_000
#: Links of a group beyond which its ids are counted before they are paired.
WIDE_GROUP = 256
_ODD_SPACE = re.compile(r"\s |^ | $")
_RUN_START = re.compile(r"(?<=\S)(?= .)", re.DOTALL)


class TwoTokenizers:
    """The ids of a run by both tokenizers, and the bytes of every id."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        size = self.a.get_vocab_size(with_added_tokens=True)
        a_tokens = [b""] * size
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            a_tokens[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^\\s▁]▁", p) for p in pieces) or any(re.search(r"\S ", t.decode(errors="replace")) for t in a_tokens):
            raise ValueError("a token holds a space after another character: texts cannot be cut at spaces")
        b_tokens = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_tokens, self.b_tokens = a_tokens, b_tokens
        self.a_length = np.array([len(t) for t in a_tokens], np.int64)
        self.b_length = np.array([len(t) for t in b_tokens], np.int64)
        self.b_bits = max(1, (len(b_tokens) - 1).bit_length())
        self.a_bits = max(1, (len(a_tokens) - 1).bit_length())
        self.runs = Runs(self)

    @staticmethod
    def cut(text: str) -> list[str]:
        """Runs of the space and the text, each without its first space."""
        if _ODD_SPACE.search(text):
            return [run[1:] for run in _RUN_START.split(" " + text)]
        return text.split(" ")

    @staticmethod
    def stretches(text: str, most: int) -> Iterator[str]:
        """The text in parts of about ``most`` characters that each start at a run, without its first space."""
        lo = 0
        while found := _RUN_START.search(text, lo + most):
            yield text[lo: found.start()]
            lo = found.start() + 1
        yield text[lo:]

    def tokens_of(self, runs: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """A and B ids of each run (with its space), None where the bytes of one of them are not the run's."""
        found = self.a.encode_batch_fast([" " + r for r in runs], add_special_tokens=False)
        for run, a, b in zip(runs, found, self.b.encode(runs, num_threads=1)):
            whole, a_ids = b" " + run.encode(), a.ids
            same = b"".join([self.a_tokens[i] for i in a_ids]) == whole == b"".join([self.b_tokens[i] for i in b])
            yield (a_ids, b) if same else None


class Runs:
    """The tokens of runs as flat arrays, with each run's number; forgotten as a whole when they outgrow their bound."""

    def __init__(self, tokenizers: TwoTokenizers):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.a, self.b, self.good = array("i"), array("i"), array("b")
        self.a_off, self.b_off = array("q", [0]), array("q", [0])
        self.bytes = 0

    def numbers(self, texts: list[list[str]]) -> list[list[int]]:
        """The number of every run of each text; unknown ones are tokenized together."""
        if self.bytes > KEPT_BYTES:
            self.clear()
        new = list({r for runs in texts for r in runs}.difference(self.number))
        for lo in range(0, len(new), 10_000):
            part = new[lo: lo + 10_000]
            for run, found in zip(part, self.tokenizers.tokens_of(part)):
                self.number[run] = len(self.good)
                a, b = found or ((), ())
                self.a.extend(a)
                self.b.extend(b)
                self.a_off.append(len(self.a))
                self.b_off.append(len(self.b))
                self.good.append(found is not None)
                self.bytes += 200 + 2 * len(run) + 4 * (len(a) + len(b))
        look = self.number.__getitem__
        return [list(map(look, runs)) for runs in texts]

    def tokens(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of A ids of each run, all of them in order, and the same of B."""
        out = []
        for ids, off in ((self.a, self.a_off), (self.b, self.b_off)):
            off = np.frombuffer(off, np.int64)
            size = off[at + 1] - off[at]
            out += [size, np.frombuffer(ids, np.int32)[spread(off[at], size)] if len(ids) else np.zeros(0, np.int32)]
        return tuple(out)


@lru_cache(maxsize=2)
def two_tokenizers(a_path: str, b_path: str) -> TwoTokenizers:
    return TwoTokenizers(a_path, b_path)


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_off: np.ndarray, b_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks the A and the B tokens that end at a cut, for lanes of tokens with their byte ends.

    Lane i holds the A tokens ``a_off[i]`` to ``a_off[i + 1]`` and the B tokens likewise, over the same bytes.
    """
    a_cut, b_cut = np.zeros(len(a_end), bool), np.zeros(len(b_end), bool)
    going = np.flatnonzero(a_off[:-1] < a_off[1:])
    a, b, stop = a_off[:-1][going], b_off[:-1][going], a_off[1:][going]
    while len(a):
        ends_a, ends_b = a_end[a], b_end[b]
        both = ends_a == ends_b
        a_cut[a[both]] = True
        b_cut[b[both]] = True
        a = a + (ends_a <= ends_b)
        b = b + (ends_b <= ends_a)
        open_lanes = a < stop
        if not open_lanes.all():
            a, b, stop = a[open_lanes], b[open_lanes], stop[open_lanes]
    return a_cut, b_cut


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - size), size)


def added_up(code: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes in rising order and the sum of the times of each."""
    order = np.argsort(code, kind="stable")
    code, times = code[order], times[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(times, first) if len(first) else times


class Merged:
    """A batch of texts, tokenized and merged: tokens, groups and the links of id pairs by document."""

    def __init__(self, two: TwoTokenizers, texts: list[str]):
        self.two, self.n = two, len(texts)
        cut = [two.cut(t) if t else [] for t in texts]
        numbers = two.runs.numbers(cut)
        at = np.fromiter((x for part in numbers for x in part), np.int64)
        doc = np.repeat(np.arange(self.n), np.array([len(p) for p in numbers], np.int64))
        self.bad = np.zeros(self.n, bool)
        self.bad[doc[np.frombuffer(two.runs.good, np.int8)[at] == 0]] = True
        at, doc = at[~self.bad[doc]], doc[~self.bad[doc]]
        n_a, self.a_ids, n_b, self.b_ids = two.runs.tokens(at)
        a_start, b_start = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        first_run = np.searchsorted(doc, np.arange(self.n + 1))
        self.a_off = np.append(a_start, len(self.a_ids))[first_run]
        self.b_off = np.append(b_start, len(self.b_ids))[first_run]
        # A lane is a document, or a stretch of a long one that starts at a run.
        stretch = (a_start - self.a_off[doc]) // LANE_TOKENS
        opens = np.ones(len(at), bool)
        opens[1:] = (doc[1:] != doc[:-1]) | (stretch[1:] != stretch[:-1])
        a_cut, b_cut = lockstep(np.cumsum(two.a_length[self.a_ids]), np.cumsum(two.b_length[self.b_ids]),
                                np.append(a_start[opens], len(self.a_ids)), np.append(b_start[opens], len(self.b_ids)))
        self.a_cut, self.b_cut = np.flatnonzero(a_cut) + 1, np.flatnonzero(b_cut) + 1
        self.group_off = np.searchsorted(self.a_cut, self.a_off, side="right")

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First A token, number of A tokens, first B token and number of B tokens of every group."""
        a_first, b_first = np.append(0, self.a_cut)[:-1], np.append(0, self.b_cut)[:-1]
        return a_first, self.a_cut - a_first, b_first, self.b_cut - b_first

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Different (document, A id, B id), as one code in rising order, and how many links each has."""
        a_first, n_a, b_first, n_b = self.groups()
        doc = np.repeat(np.arange(self.n), np.diff(self.group_off))
        wide = n_a * n_b > WIDE_GROUP
        codes, times = [], []
        narrow = np.flatnonzero(~wide)
        per_group = n_a[narrow] * n_b[narrow]
        within = spread(np.zeros(len(narrow), np.int64), per_group)
        nb = np.repeat(n_b[narrow], per_group)
        a = self.a_ids[np.repeat(a_first[narrow], per_group) + within // np.maximum(nb, 1)]
        b = self.b_ids[np.repeat(b_first[narrow], per_group) + within % np.maximum(nb, 1)]
        codes.append(self._code(np.repeat(doc[narrow], per_group), a, b))
        times.append(np.ones(len(a), np.int64))
        for g in np.flatnonzero(wide):
            a, a_times = np.unique(self.a_ids[a_first[g]: a_first[g] + n_a[g]], return_counts=True)
            b, b_times = np.unique(self.b_ids[b_first[g]: b_first[g] + n_b[g]], return_counts=True)
            codes.append(self._code(np.full(len(a) * len(b), doc[g]), np.repeat(a, len(b)), np.tile(b, len(a))))
            times.append(np.outer(a_times, b_times).ravel())
        return added_up(np.concatenate(codes), np.concatenate(times))

    def _code(self, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (doc.astype(np.int64) << (self.two.a_bits + self.two.b_bits)) | (a.astype(np.int64) << self.two.b_bits) | b

    def texts_of_groups(self) -> list[str]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``."""
        a_first, n_a, b_first, n_b = self.groups()
        # Tokens in the order A of group 1, B of group 1, A of group 2, ...; each with the mark that follows it.
        start = np.ravel(np.column_stack([a_first, b_first + len(self.a_ids)]))
        size = np.ravel(np.column_stack([n_a, n_b]))
        order = spread(start, size)
        last = np.cumsum(size) - 1
        mark = np.zeros(len(order), np.int8)
        mark[last[0::2]], mark[last[1::2]] = 1, 2
        ids = np.concatenate([self.a_ids, self.b_ids])[order].astype(np.int64)
        n_per_doc = np.diff(self.a_off) + np.diff(self.b_off)
        written = decimals(max(len(self.two.a_tokens), len(self.two.b_tokens)))[ids * 3 + mark].tolist()
        ends = np.cumsum(n_per_doc)
        return ["".join(written[e - n: e])[:-1] for e, n in zip(ends.tolist(), n_per_doc.tolist())]


@lru_cache(maxsize=1)
def decimals(most: int) -> np.ndarray:
    """Ids in decimal with the mark after them: within a side, after the A side, after the group."""
    return np.array([f"{i}{mark}" for i in range(most) for mark in ",|;"], object)


class Unit:
    """Documents and their id pairs, up to about UNIT_ENTRIES of them together."""

    def __init__(self, pair_bits: int):
        self.pair_bits, self.codes, self.times, self.rows, self.docs, self.entries = pair_bits, [], [], [], 0, 0

    def add(self, ids: list, merged: Merged) -> None:
        code, times = merged.links()
        n_links = np.bincount(code >> self.pair_bits, times, merged.n).astype(np.int64)
        n_a, n_b, n_groups = np.diff(merged.a_off), np.diff(merged.b_off), np.diff(merged.group_off)
        sha = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in merged.texts_of_groups()]
        self.rows += zip(ids, n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), sha)
        self._keep(code, times, merged.n)

    def add_long(self, doc_id: int | None, two: TwoTokenizers, text: str) -> None:
        """One text that is merged stretch by stretch."""
        total, code, times, sha = np.zeros(4, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), hashlib.sha256()
        for part in two.stretches(text, BATCH_BYTES // 2):
            merged = Merged(two, [part])
            if merged.bad[0]:
                total, code, times = np.zeros(4, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                break
            more, more_times = merged.links()
            sha.update((";" if total[0] else "").encode() + merged.texts_of_groups()[0].encode())
            total += [len(merged.a_ids), len(merged.b_ids), len(merged.a_cut), more_times.sum()]
            code, times = added_up(np.concatenate([code, more]), np.concatenate([times, more_times]))
        self.rows.append((doc_id, *total.tolist(), sha.hexdigest() if total[0] else ""))
        self._keep(code, times, 1)

    def _keep(self, code: np.ndarray, times: np.ndarray, n: int) -> None:
        self.codes.append(code + (self.docs << self.pair_bits))
        self.times.append(times)
        self.docs += n
        self.entries += len(code) + 8 * n

    def full(self) -> bool:
        return self.entries >= UNIT_ENTRIES

    def batches(self, number: int) -> Iterator[pa.RecordBatch]:
        """A row for each document, with its pairs as places in the unit's list, and one for the list."""
        code, times = np.concatenate(self.codes), np.concatenate(self.times)
        pairs, place, n_docs = np.unique(code & ((1 << self.pair_bits) - 1), return_inverse=True, return_counts=True)
        off = np.searchsorted(code >> self.pair_bits, np.arange(self.docs + 1))
        for lo in range(0, self.docs, 10_000):
            part = self.rows[lo: lo + 10_000]
            at = off[lo: lo + len(part) + 1]
            binary = [(place[s:e].astype("<u4").tobytes(), times[s:e].astype("<u8").tobytes() if e > s and times[s:e].max() > 255
                       else times[s:e].astype("u1").tobytes()) for s, e in zip(at[:-1], at[1:])]
            doc_id, n_a, n_b, n_groups, n_links, sha = zip(*part)
            yield unit_batch([number] * len(part), doc_id, n_a, n_b, n_groups, n_links, sha, [p for p, _ in binary], [t for _, t in binary])
        # The list, in parts; the first place of a part stands in the column of the id.
        for lo in range(0, len(pairs), 200_000):
            yield unit_batch([number], [lo], [0], [0], [0], [0], [None], [pairs[lo: lo + 200_000].astype("<i8").tobytes()],
                             [n_docs[lo: lo + 200_000].astype("<u4").tobytes()])


UNIT_SCHEMA = "unit long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary"


def unit_batch(*columns) -> pa.RecordBatch:
    types = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]
    names = [f.split()[0] for f in UNIT_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def batches_of(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, about BATCH_BYTES of them at a time; a longer text is a batch of its own."""
    ids, texts, size = [], [], 0
    for batch in rows:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            length = text.as_buffer().size if text.is_valid else 0
            if texts and size + length > BATCH_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(text.as_py() or "")
            size += length
    if ids:
        yield ids, texts


def merge_documents(a_path: str, b_path: str):
    """The function over Arrow batches that tokenizes, merges and gathers units."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = two_tokenizers(a_path, b_path)
        bits = two.a_bits + two.b_bits
        number, unit = TaskContext.get().partitionId() << 32, Unit(bits)
        for ids, texts in batches_of(rows):
            if len(texts) == 1 and len(texts[0]) > BATCH_BYTES:
                unit.add_long(ids[0], two, texts[0])
            else:
                unit.add(ids, Merged(two, texts))
            if unit.full():
                yield from unit.batches(number)
                number, unit = number + 1, Unit(bits)
        if unit.docs:
            yield from unit.batches(number)
    return run


PAIRS_SCHEMA = "unit long, place long, pair long, n_docs long"


def listed_pairs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of the units, one row a pair."""
    for batch in rows:
        for row in batch.to_pylist():
            pairs, n_docs = np.frombuffer(row["places"], "<i8"), np.frombuffer(row["times"], "<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row["unit"])), pa.array(np.arange(len(pairs)) + row["doc_id"]), pa.array(pairs),
                                              pa.array(n_docs)], names=["unit", "place", "pair", "n_docs"])


ALIGNED_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The sums of each document of a unit over its links."""
    count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
    place = pairs["place"].to_numpy()
    count[place], best[place] = pairs["count"].to_numpy(), pairs["best"].to_numpy().astype(np.int64)
    n_best, count_sum = [], []
    for n_links, places, times in zip(docs["n_links"].to_pylist(), docs["places"].to_pylist(), docs["times"].to_pylist()):
        at = np.frombuffer(places, "<u4")
        n = np.frombuffer(times, "u1" if len(times) == len(at) else "<u8").astype(np.int64)
        n_best.append(int(n @ best[at]))
        count_sum.append(int(n @ count[at]))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())) \
        .append_column("groups_sha256", docs["groups_sha256"])


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: tokens, groups and links of the two tokenizers, and the sums over the corpus-wide counts of its pairs."""
    spark = docs.sparkSession
    path = flatfiles.scratch_folder(spark, "aligned")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows.mapInArrow(merge_documents(a_path, b_path), UNIT_SCHEMA).withColumn("list", F.col("groups_sha256").isNull()) \
        .write.partitionBy("list").option("compression", "zstd").parquet(path)
    stored = spark.read.schema(UNIT_SCHEMA + ", list boolean").parquet(path)
    lists = stored.where("list").select("unit", "doc_id", "places", "times").mapInArrow(listed_pairs, PAIRS_SCHEMA)
    b_bits = two_tokenizers(a_path, b_path).b_bits
    counts = lists.groupBy("pair").agg(F.sum("n_docs").alias("count"))
    # No A id has more pairs than there are B ids.
    highest = F.max("count").over(Window.partitionBy(F.shiftright("pair", b_bits)))
    counts = counts.withColumn("best", F.col("count") == highest)
    by_unit = lists.drop("n_docs").join(counts, "pair").select("unit", "place", "count", "best")
    per_doc = stored.where("not list").drop("list")
    return per_doc.groupBy("unit").cogroup(by_unit.groupBy("unit")).applyInArrow(summed, ALIGNED_SCHEMA)


def linked_ids(text: str, a_path: str, b_path: str) -> list[tuple[list[int], list[int]]]:
    """The groups of one text: its A and B ids between two cuts."""
    merged = Merged(two_tokenizers(a_path, b_path), [text])
    a_first, n_a, b_first, n_b = merged.groups()
    return [(merged.a_ids[s:s + n].tolist(), merged.b_ids[t:t + m].tolist()) for s, n, t, m in zip(a_first, n_a, b_first, n_b)]
