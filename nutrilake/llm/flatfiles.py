"""Token counts by a separator scan over flat token files (operator 7).

A flat token file is a run of big-endian unsigned 16-bit ids without an
index: documents follow one another, each closed by the end-of-document id.
The scan reads a file in blocks, searches each block for the id with one
vectorised comparison, and joins the blocks with a prefix scan: the running
maximum of the last separator before each block gives the place where the
document that is open at the block's start began.

``write_token_files`` makes such files from a table with Spark's text writer
(gzip as the codec; its line separator is the last byte of the
end-of-document id). A document may begin with id tokens, which the scan
reads back as its integer id.

Null and empty texts give documents of no tokens, with one separator each;
a missing id stays missing.
Repeated rows are documents of their own. An empty table gives no files and
an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nutrilake.llm.bpe import byte_bpe, byte_slices
from nutrilake.session import shared_path

#: Tokens of a document's id: base-2^15 digits, so that none can be a separator.
ID_TOKENS = 5
BLOCK_BYTES = 1 << 20


def id_tokens(ids: pa.Array) -> np.ndarray:
    """Each 64-bit id as ID_TOKENS digits of 15 bits, highest first; a null id has a first digit that no id has."""
    shifts = np.arange(15 * (ID_TOKENS - 1), -1, -15, dtype=np.uint64)
    whole = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    digits = ((whole[:, None] >> shifts) & np.uint64(0x7FFF)).astype(">u2")
    digits[~ids.is_valid().to_numpy(zero_copy_only=False), 0] = 0x7FFF
    return digits


def ids_of(tokens: np.ndarray) -> pa.Array:
    out = np.zeros(len(tokens), np.uint64)
    for j in range(ID_TOKENS):
        out = (out << np.uint64(15)) | tokens[:, j].astype(np.uint64)
    return pa.array(out.view(np.int64), mask=tokens[:, 0] == 0x7FFF)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, pattern: str, separator: int, doc_id: str = "doc_id",
                      text: str = "text") -> None:
    """Encodes every text and writes flat token files; the separator must lie above the ids and end in an ASCII byte."""
    last = separator & 0xFF
    if last >= 0x80 or separator > 0xFFFF:
        raise ValueError("the separator's low byte must be ASCII and its id below 65536")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(vocabulary, pattern)
        if len(codec.tokens) > separator:
            raise ValueError("the separator is an id of the vocabulary")
        closing = bytes([separator >> 8])
        for batch in batches:
            for part in byte_slices(batch, 1):
                heads = id_tokens(part.column(0))
                found = codec.encode(part.column(1).fill_null("").to_pylist())
                rows = [h.tobytes() + np.frombuffer(x, "<u4").astype(">u2").tobytes() + closing for h, x in zip(heads, found)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    flat = docs.select(F.col(doc_id).cast("bigint"), text).mapInArrow(run, "value binary")
    flat.select(F.col("value").cast("string")).write.mode("overwrite") \
        .option("compression", "gzip").option("lineSep", chr(last)).text(path)


def blocks_of(content: bytes, block_bytes: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    """The file's ids block by block; gzip content is unpacked as it is read."""
    if content[:2] == b"\x1f\x8b":
        unpack, rest, data = zlib.decompressobj(31), b"", memoryview(content)
        while len(data):
            raw = rest + unpack.decompress(data[:block_bytes])
            data = data[block_bytes:]
            if unpack.eof and len(unpack.unused_data):  # the next member
                data = memoryview(bytes(unpack.unused_data) + bytes(data))
                unpack = zlib.decompressobj(31)
            cut = len(raw) // 2 * 2
            rest = raw[cut:]
            for lo in range(0, cut, block_bytes):
                yield np.frombuffer(raw[lo: min(lo + block_bytes, cut)], ">u2")
    else:
        for lo in range(0, len(content) // 2 * 2, block_bytes):
            yield np.frombuffer(content, ">u2", min(block_bytes, len(content) - lo) // 2, lo)


def scan_file(content: bytes, separator: int, head: int = 0, block_bytes: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each document of a file without its ``head`` tokens, and those head tokens.

    What follows the last separator is a document too if it is not empty.
    """
    if block_bytes % 2:
        raise ValueError("blocks hold whole ids")
    hits, sizes, heads, open_head = [], [], [], np.zeros(0, ">u2")
    for block in blocks_of(content, block_bytes):
        at = np.flatnonzero(block == separator)
        hits.append(at)
        sizes.append(len(block))
        if head:
            # Starts in this block: those of the documents that the block's separators close, and of the one left open.
            starts = np.concatenate([[0], at + 1])
            window = np.concatenate([open_head, block])
            shift = len(open_head)
            first = np.concatenate([[0], starts[1:] + shift])
            whole = first[:-1]
            heads.append(window[whole[:, None] + np.arange(head)] if len(whole) else np.zeros((0, head), ">u2"))
            open_head = window[first[-1]: first[-1] + head]
    if not hits:
        return np.zeros(0, np.int64), np.zeros((0, head), ">u2")
    base = np.concatenate([[0], np.cumsum(sizes)])
    # Prefix scan over blocks: the last separator before each block, -1 before the first.
    last = np.array([base[i] + h[-1] if len(h) else -1 for i, h in enumerate(hits)])
    before = np.maximum.accumulate(np.concatenate([[-1], last]))
    counts = [np.diff(np.concatenate([[before[i]], base[i] + h])) - 1 - head for i, h in enumerate(hits) if len(h)]
    tail = base[-1] - 1 - before[-1]
    if tail > 0:
        counts.append(np.array([tail - head]))
        if head:
            heads.append(open_head[None, :])
    return (np.concatenate(counts) if counts else np.zeros(0, np.int64),
            np.concatenate(heads) if heads else np.zeros((0, head), ">u2"))


def separator_scan(spark: SparkSession, path: str, separator: int, with_ids: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document of the flat files under ``path``: ``file``, ``ordinal`` in it, ``n_tokens`` and, if the files have them, ``doc_id``."""
    schema = "file string, ordinal long, n_tokens long" + (", doc_id long" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                counts, heads = scan_file(content.as_py(), separator, ID_TOKENS if with_ids else 0, block_bytes)
                out = {"file": [name.as_py()] * len(counts), "ordinal": np.arange(len(counts)), "n_tokens": counts}
                if with_ids:
                    out["doc_id"] = ids_of(heads)
                yield pa.RecordBatch.from_pydict(out)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder."""
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote, through Spark's own file systems."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
