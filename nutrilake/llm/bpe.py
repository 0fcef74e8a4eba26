"""Byte-level BPE encoding and decoding (operator 8) with the tokenizers library over Arrow batches.

A rank file (token bytes and their ranks) becomes a byte-level BPE model:
bytes are mapped to printable characters, and a pair merges if its bytes
together are a token, lowest rank first. Texts are cut by the pattern and
each piece is a word of its own for the library; the ids of a piece are kept
for later texts, up to a bounded number of pieces.

Decoding looks up each id's bytes and joins them: characters that are split
over several tokens come out whole, since bytes are joined before they are
read as UTF-8. ``decode_stream`` gives text from ids piece by piece and holds
back an unfinished character.

Null and empty texts give no ids. Rows are encoded one by one: ties, repeated
rows and extra columns do not matter (a clashing column is replaced), and an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer, decoders, models, pre_tokenizers

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of strings and ids that a worker keeps, what an entry takes besides, and the longest string that is kept.
KEPT_BYTES, ENTRY_BYTES, LONGEST_KEPT = 160_000_000, 180, 200
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUN = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_SPACE_RUN = re.compile(f" (?:[{_WHITE}]|$)")


def byte_characters() -> list[str]:
    """The printable character of each byte in the tokenizers library: printable Latin-1 bytes are themselves, the rest follow from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank; the ranks of the file must run from 0 without a gap."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    return tokens


def build_tokenizer(tokens: list[bytes]) -> Tokenizer:
    """The rank table as a model of the tokenizers library: every split of a token into two tokens merges, in order of rank.

    It takes each text as one piece; cutting by the pattern comes before it.
    """
    chars = byte_characters()
    text = ["".join(chars[b] for b in token) for token in tokens]
    vocabulary = {t: i for i, t in enumerate(text)}
    merges = [(t[:k], t[k:]) for t in text for k in range(1, len(t)) if t[:k] in vocabulary and t[k:] in vocabulary]
    tokenizer = Tokenizer(models.BPE(vocabulary, merges))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


class Kept:
    """A memory of ids by string, bounded in bytes: what was not used since the last turn but one is forgotten, long strings at once."""

    def __init__(self, most: int = KEPT_BYTES // 4):
        self.most = most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes = 0
        self.long: list[str] = []

    def add(self, key: str, ids: bytes) -> None:
        self.new[key] = ids
        if len(key) > LONGEST_KEPT:
            self.long.append(key)
        else:
            self.bytes += ENTRY_BYTES + len(key) + len(ids)

    def unknown(self, keys: set[str]) -> set[str]:
        """Those of ``keys`` that are not known; the others are ready in ``new``."""
        away = keys.difference(self.new)
        back = [k for k in away if k in self.old]
        for k in back:
            self.add(k, self.old[k])
        return away.difference(back)

    def turn(self) -> None:
        for key in self.long:
            del self.new[key]
        self.long.clear()
        if self.bytes > self.most:
            self.old, self.new, self.bytes = self.new, {}, 0


class ByteBpe:
    """Encoder and decoder of one rank file and pattern; one of each is kept a worker process."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokens = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.tokenizer = build_tokenizer(self.tokens)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.pieces, self.runs = Kept(), Kept()

    @staticmethod
    def cut(text: str) -> list[str]:
        """The text in runs that no match of the pattern crosses: each starts with white space and ends before the next.

        The pattern looks ahead only over white space, and a match holds none but at its start. Where every space
        stands right before another character, cutting at spaces is the same and quicker.
        """
        if _SPACE_RUN.search(text):
            return _RUN.findall(text)
        head, *rest = text.split(" ")
        return [head, *map(" ".__add__, rest)]

    def _learn(self, runs: set[str]) -> None:
        cuts = {run: self.pattern.findall(run) for run in runs}
        new = list(self.pieces.unknown({p for pieces in cuts.values() for p in pieces}))
        for lo in range(0, len(new), 10_000):
            part = new[lo: lo + 10_000]
            for piece, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.pieces.add(piece, array("I", found.ids).tobytes())
        ids = self.pieces.new.__getitem__
        for run, pieces in cuts.items():
            self.runs.add(run, b"".join(map(ids, pieces)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            runs = self.cut(text)
            try:
                out.append(b"".join(map(self.runs.new.__getitem__, runs)))
            except KeyError:
                self._learn(self.runs.unknown(set(runs)))
                out.append(b"".join(map(self.runs.new.__getitem__, runs)))
                self.runs.turn()
                self.pieces.turn()
        return out

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Start and end of each token in code points; a character split over tokens belongs to all of them."""
        first = np.cumsum([0, *(len(c.encode()) for c in text)])
        end = np.cumsum(self.lengths[np.frombuffer(self.encode([text])[0], "<u4")]) if text else np.zeros(0, np.int64)
        start = np.concatenate([[0], end[:-1]]) if len(end) else end
        return list(zip((np.searchsorted(first, start, "right") - 1).tolist(), np.searchsorted(first, end, "left").tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, joined."""
        size = self.lengths[ids]
        end = np.cumsum(size)
        if not len(end):
            return b""
        shift = np.repeat(self.starts[ids] - (end - size), size)
        return self.flat[shift + np.arange(end[-1])].tobytes()

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text id by id; a character that is not whole yet is held back."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield reader.decode(self.tokens[i])
        yield reader.decode(b"", True)


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (array of int), the ids of ``text``."""
    keep = [c for c in docs.columns if c != ids]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(path, pattern)
        for batch in batches:
            for part in byte_slices(batch, keep.index(text)):
                found = codec.encode(part.column(keep.index(text)).fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, id_lists(found)], names=[*keep, ids])

    return docs.select(*(f"`{c}`" for c in keep)).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out`` (binary), the bytes that ``ids`` stand for; null ids give no bytes."""
    keep = [c for c in docs.columns if c != out]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(path, pattern)
        for batch in batches:
            lists = batch.column(keep.index(ids))
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                made = [codec.decode(np.asarray(x.values) if x.is_valid else np.zeros(0, np.int64)) for x in lists.slice(lo, 500)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*keep, out])

    return docs.select(*(f"`{c}`" for c in keep)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str | None = None) -> DataFrame:
    """``docs`` without ``text`` and with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: each text encoded, and its ids decoded again.

    With ``ids``, the ids themselves too, in an array column of that name.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *([ids] if ids else [])]
    keep = [c for c in docs.columns if c not in (text, *names)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType())]
                          + [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")]
                          + [T.StructField(c, T.ArrayType(T.IntegerType(), False)) for c in names[3:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(path, pattern)
        for batch in batches:
            for part in byte_slices(batch, len(keep)):
                found = codec.encode(part.column(len(keep)).fill_null("").to_pylist())
                back = [codec.decode(np.frombuffer(x, "<u4")) for x in found]
                out = [*part.columns[: len(keep)], pa.array([len(x) // 4 for x in found], pa.int64()),
                       pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
                       pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
                yield pa.RecordBatch.from_arrays(out + ([id_lists(found)] if ids else []), names=[*keep, *names])

    return docs.select(*(f"`{c}`" for c in keep), text).mapInArrow(run, schema)


def id_lists(found: list[bytes]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32))
    return pa.ListArray.from_arrays(pa.array(ends), values, type=pa.list_(pa.field("element", pa.int32(), False)))


def byte_slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of the column together."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        done = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, done + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
