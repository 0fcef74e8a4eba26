"""Vectorised helpers over the UTF-8 bytes of a column of texts (numpy, inside tasks).

A batch of texts is one flat byte array and the offsets of its documents;
words, lines and n-grams of all of them are found and hashed without a loop
over rows. Nulls count as empty texts everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1_000_000

#: Byte classes of the word pattern [^\x20\x09-\x0D]+ (fixed values).
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix finaliser)."""
    x = x.astype(U64, copy=True)
    x += U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as doubles in [0, 1)."""
    return (x >> U64(11)).astype(np.float64) * (1.0 / (1 << 53))


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        size = 1 << int(n - 1).bit_length()
        steps = np.full(size, base, U64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have


class Texts:
    """Documents ``lo`` to ``hi`` of a batch as bytes: ``data`` and ``off`` (start of each, and the end)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lo: int, hi: int):
        self.data, self.off, self.lo, self.hi = data, off, lo, hi
        self.n = hi - lo
        self._prefix = None
        self._words = None

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, position, side="right") - 1

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document are set in ``mask``."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of all words."""
        if self._words is None:
            space = IS_SPACE[self.data]
            before = np.concatenate([[True], space[:-1]]) if len(space) else space.copy()
            after = np.concatenate([space[1:], [True]]) if len(space) else space.copy()
            first = self.off[:-1][self.off[:-1] < self.off[1:]]
            before[first] = True
            after[self.off[1:][self.off[:-1] < self.off[1:]] - 1] = True
            start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
            self._words = start, end, self.doc_of(start)
        return self._words

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends (without the newline) and documents of all lines."""
        cut = np.flatnonzero(self.data == 10)
        start = np.concatenate([self.off[:-1], cut + 1])
        end = np.concatenate([self.off[1:], cut])
        doc = np.concatenate([np.arange(self.n), self.doc_of(cut)])
        start, end = start[np.lexsort((start, doc))], end[np.lexsort((end, doc))]
        return start, end, np.sort(doc, kind="stable")

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges; equal bytes have equal hashes at any place."""
        if self._prefix is None:
            up = _power_table("up", _BASE, len(self.data) + 1)
            with np.errstate(over="ignore"):
                self._prefix = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE_VALUE[self.data] * up[: len(self.data)], dtype=U64)])
        down = _power_table("down", _BASE_INV, len(self.data) + 1)
        with np.errstate(over="ignore"):
            return mix64((self._prefix[end] - self._prefix[start]) * down[start] + (end - start).astype(U64))


def texts_of(column: pa.Array | pa.ChunkedArray, max_bytes: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The column in runs of documents of about ``max_bytes`` together; a longer document makes a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset: column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, n)
        yield Texts(raw[off[lo]: off[hi]], off[lo: hi + 1] - off[lo], lo, hi)
        lo = hi


def ngram_hashes(word_hash: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` words within a document, and the index of each run's first word."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[n - 1:])
    with np.errstate(over="ignore"):
        total = word_hash[at].copy()
        for j in range(1, n):
            total = total * U64(0xD6E8FEB86659FD93) + word_hash[at + j]
    return mix64(total), at


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: does it occur twice or more; and is an equal one earlier in the array."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    later[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later
