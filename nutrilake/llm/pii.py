"""Personal data: fixed patterns and a skip-chain conditional random field (operator 10).

The patterns find e-mail addresses, IP addresses, payment cards and phone
numbers. The field then labels every token that holds a digit or an at sign:
a token's shape gives its own potential, neighbouring tokens share chain
potentials, and tokens of a document that repeat one another (equal, or equal
in their last digits) share skip potentials however far apart they stand:
each mention is linked to the first one that a pattern found, of each kind, or
to the first mention at all where no pattern found one.
Loopy message passing over all three gives each token's marginals; tokens of
patterns are held at their kind, and further tokens become spans where a
marginal is high. Potentials are learnt from the patterns' own labels by
pseudo-likelihood on a bounded sample of documents.

Spans are in code points, end exclusive, ordered by start and then by kind.
Null and empty texts have no spans. Documents are labelled one by one, so
ties and repeated rows do not matter; other columns pass through and clashing
ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nutrilake.llm.textbytes import texts_of

KINDS = ("email", "ip", "card", "phone")
#: The patterns' fixed values; digit runs are possessive and start where a run starts, which finds the same matches in linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

_TOKEN = re.compile(r"\S+")
_MARK = re.compile("[0-9@]")
_SHAPE = re.compile(r"[0-9]+|[^\W0-9_]+")
#: Documents that the potentials are learnt from, and tokens of each, at most; buckets of shapes; the marginal that makes a span.
SAMPLE_DOCS, SAMPLE_TOKENS, SHAPES, SURE = 4000, 2000, 4096, 0.95
#: Log odds that a repeated token has the label of its other occurrence, before anything is learnt.
SAME = 8.0
_IS_MARK = np.zeros(256, bool)
_IS_MARK[[*range(0x30, 0x3A), 0x40]] = True

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        # The local part is the run of its characters before the sign, not before the last match's end.
        lo = at
        while lo > done and not _NOT_LOCAL.match(text[lo - 1]):
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at)):
            yield lo, 0, m.end()
            done = m.end()
        elif lo == at or not m:
            done = max(done, at)  # what lies before a failed sign cannot belong to a later one
        at += 1


def base_spans(text: str) -> list[Span]:
    """The patterns' matches that pass their checks, leftmost and non-overlapping within a kind."""
    spans = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGIT.findall(m[0]))
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def shape(core: str) -> str:
    """A token's look: letter runs as ``a``, digit runs as ``d`` and, from four on, their length; whether its numbers pass the kinds' checks."""
    look = _SHAPE.sub(lambda m: "a" if not m[0][0].isascii() or m[0][0].isalpha() else "d" if len(m[0]) < 4 else f"d{min(len(m[0]), 20)}", core)
    digits = "".join(_DIGIT.findall(core))
    if 12 <= len(digits) <= 19:
        look += " luhn" if luhn(digits) else " none"
    if look == "d.d.d.d":
        look += " range" if all(int(p) <= 255 for p in core.split(".")) else " none"
    return look


class Nodes(NamedTuple):
    """Tokens of one document as the field's nodes, and its edges as pairs of nodes."""

    start: list[int]
    end: list[int]
    shape: list[int]
    label: list[int]  # 0: none, else kind + 1, by the patterns
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def nodes_of(text: str, spans: list[Span]) -> Nodes:
    out = Nodes([], [], [], [], [], [])
    mentions: dict[str, list[int]] = {}
    before, at = -2, 0
    for order, m in enumerate(_TOKEN.finditer(text)):
        if not _MARK.search(m[0]):
            continue
        core = m[0].rstrip(".,;:!?\"'")
        lo = m.start() + len(core) - len(core := core.lstrip("\"'"))
        if not core:
            continue
        i, hi = len(out.start), lo + len(core)
        while at < len(spans) and spans[at][2] <= lo:
            at += 1
        # From the first span that is not over; those that it holds within are few, as a span has at most 19 digits.
        k, label = at, 0
        while not label and k < len(spans) and spans[k][0] < hi:
            label = spans[k][1] + 1 if spans[k][2] > lo else 0
            k += 1
        for field, value in zip(out, (lo, hi, zlib.crc32(shape(core).encode()) % SHAPES, label)):
            field.append(value)
        if order == before + 1:
            out.chain.append((i - 1, i))
        digits = "".join(_DIGIT.findall(core))
        # Equal tokens of seven digits or more are also equal in their last ones, so that one key tells both.
        mentions.setdefault(f"#{digits[-7:]}" if len(digits) >= 7 else core.lower(), []).append(i)
        before = order
    chained = set(out.chain)
    for at_key in mentions.values():
        if len(at_key) > 1:
            # Stars around the first mention of each kind: linear in mentions, and what no pattern found does not outvote what one did.
            held: dict[int, int] = {}
            for i in at_key:
                if out.label[i]:
                    held.setdefault(out.label[i], i)
            edges = {(min(i, hub), max(i, hub)) for hub in held.values() or at_key[:1] for i in at_key if i != hub}
            out.skip.extend(sorted(edges - chained))
    return out


class Field(NamedTuple):
    """Log potentials: shape by label, label by next label, label by repeated token's label."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


LABELS = len(KINDS) + 1


def fit_field(shapes: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 300, rate: float = 0.1,
              decay: float = 1e-3) -> Field:
    """Potentials of the highest pseudo-likelihood: each token's label given its shape and its neighbours' labels (Adam, full batch)."""
    start = np.zeros((SHAPES, LABELS))
    start[:, 0] = 4.0  # a shape that was never seen is no personal data
    centre = [start, np.zeros((LABELS, LABELS)), SAME * np.eye(LABELS)]
    parts = [c.copy() for c in centre]
    if not len(shapes):
        return Field(*parts)
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in parts]
    truth = np.eye(LABELS)[labels]
    for step in range(1, steps + 1):
        score = parts[0][shapes].copy()
        for w, edges in ((parts[1], chain), (parts[2], skip)):
            if len(edges):
                np.add.at(score, edges[:, 1], w[labels[edges[:, 0]]])
                np.add.at(score, edges[:, 0], w[:, labels[edges[:, 1]]].T)
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        gap = p / p.sum(axis=1, keepdims=True) - truth
        slopes = [np.zeros_like(p_) for p_ in parts]
        np.add.at(slopes[0], shapes, gap)
        for slope, edges in ((slopes[1], chain), (slopes[2], skip)):
            if len(edges):
                np.add.at(slope, labels[edges[:, 0]], gap[edges[:, 1]])
                np.add.at(slope.T, labels[edges[:, 1]], gap[edges[:, 0]])
        for k, (part, slope) in enumerate(zip(parts, slopes)):
            slope += decay * (part - centre[k])
            m, v = moment[k]
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            part -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Field(*parts)


def marginals(field: Field, shapes: np.ndarray, held: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Loopy sum-product: each token's label probabilities; tokens with ``held`` above 0 have that label."""
    own = field.unary[shapes].copy()
    at = np.flatnonzero(held)
    own[at] = -1e9  # more than any number of neighbours can say
    own[at, held[at]] = 0.0
    edges = np.concatenate([chain, skip]).astype(np.int64).reshape(-1, 2)
    if not len(edges):
        belief = own
    else:
        both = np.concatenate([np.repeat(field.chain[None], len(chain), 0), np.repeat(field.skip[None], len(skip), 0)])
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([both, both.transpose(0, 2, 1)])  # [source label, target label]
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), LABELS))
        for _ in range(rounds):
            belief = own.copy()
            np.add.at(belief, target, message)
            out = (belief[source] - message[back])[:, :, None] + pair
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            message = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
        belief = own.copy()
        np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _joined(parts: list[Nodes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    shapes, labels = (np.array([x for n in parts for x in getattr(n, c)], np.int64) for c in ("shape", "label"))
    first = np.cumsum([0, *(len(n.start) for n in parts)])
    chain, skip = (np.array([(a + f, b + f) for n, f in zip(parts, first) for a, b in getattr(n, c)], np.int64).reshape(-1, 2)
                   for c in ("chain", "skip"))
    return shapes, labels, chain, skip


def all_spans(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text; the field adds spans that overlap no base span."""
    base = [base_spans(t) for t in texts]
    parts = [nodes_of(t, s) for t, s in zip(texts, base)]
    shapes, labels, chain, skip = _joined(parts)
    if not len(shapes):
        return [(s, s) for s in base]
    p = marginals(field, shapes, labels, chain, skip)
    kind = np.where(p[:, 1:].max(axis=1) >= SURE, p[:, 1:].argmax(axis=1), -1)
    kind[labels > 0] = -1
    out, i = [], 0
    for text, spans, nodes in zip(texts, base, parts):
        added: list[Span] = []
        linked = set(nodes.chain)
        for j in range(len(nodes.start)):
            k = int(kind[i + j])
            if k < 0:
                continue
            if added and added[-1][1] == k and k == 3 and (j - 1, j) in linked and added[-1][2] == nodes.end[j - 1]:
                added[-1] = (added[-1][0], k, nodes.end[j])  # a phone number goes on over tokens
            else:
                added.append((nodes.start[j], k, nodes.end[j]))
        i += len(nodes.start)
        out.append((spans, sorted(spans + added) if added else spans))
    return out


def first_nodes(nodes: Nodes, most: int) -> Nodes:
    """The first ``most`` nodes and the edges among them."""
    return Nodes(nodes.start[:most], nodes.end[:most], nodes.shape[:most], nodes.label[:most],
                 [e for e in nodes.chain if max(e) < most], [e for e in nodes.skip if max(e) < most])


def learn_field(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS,
                sample_tokens: int = SAMPLE_TOKENS) -> Field:
    """Potentials from at most ``sample_docs`` documents that hold a digit or an at sign, by hash order of the id, one row an id,
    and at most the first ``sample_tokens`` nodes of each."""
    ids = docs.where(F.col(text).rlike("[0-9@]") & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id")).distinct() \
        .orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [first_nodes(nodes_of(t, base_spans(t)), sample_tokens) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "shape": [n.shape for n in parts], "label": [n.label for n in parts],
                "chain": [[x for e in n.chain for x in e] for n in parts], "skip": [[x for e in n.skip for x in e] for n in parts]},
                schema=pa.schema([(c, pa.list_(pa.int32())) for c in ("shape", "label", "chain", "skip")]))

    # At most sample_docs ids; rows that share one are merged before they are shuffled.
    sample = docs.where(F.col(text).rlike("[0-9@]")).join(F.broadcast(ids), F.col(doc_id) == F.col("_id")).groupBy("_id").agg(F.min(text).alias(text)).select(text)
    rows = sample.mapInArrow(read, ", ".join(f"{c} array<int>" for c in ("shape", "label", "chain", "skip"))).collect()
    parts = [Nodes([0] * len(r["shape"]), [], r["shape"], r["label"], list(zip(r["chain"][::2], r["chain"][1::2])),
                   list(zip(r["skip"][::2], r["skip"][1::2]))) for r in rows]
    return fit_field(*_joined(sorted(parts)))


def _marked_rows(column: pa.Array) -> np.ndarray:
    """Rows that hold a digit or an at sign."""
    return np.concatenate([np.zeros(0, bool), *(t.per_doc(_IS_MARK[t.data]) > 0 for t in texts_of(column))])


def find(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with base counts, ``base_sha256`` and ``spans`` (``kind:start:end``, comma-joined)."""
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    keep = [c for c in docs.columns if c not in (text, *names)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in names[:4]]
                          + [T.StructField(c, T.StringType()) for c in names[4:]])

    def said(spans: list[Span]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            rows = np.flatnonzero(_marked_rows(column))
            found: list[tuple[list[Span], list[Span]]] = [([], [])] * batch.num_rows
            for lo in range(0, len(rows), 200):
                some = rows[lo: lo + 200]
                for r, got in zip(some, all_spans(field, column.take(pa.array(some)).to_pylist())):
                    found[r] = got
            counts = [pa.array([sum(s[1] == k for s in b) for b, _ in found], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *counts, pa.array([hashlib.sha256(said(b).encode()).hexdigest() for b, _ in found], pa.string()),
                 pa.array([said(a) for _, a in found], pa.string())], names=[*keep, *names])

    return docs.select(*(f"`{c}`" for c in keep), text).mapInArrow(run, schema)


def redact(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets; overlapping spans are replaced as one, by the first one's kind."""
    names, place = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            rows = np.flatnonzero(_marked_rows(column))
            new: dict[int, str] = {}
            for lo in range(0, len(rows), 200):
                some = rows[lo: lo + 200]
                texts = column.take(pa.array(some)).to_pylist()
                for r, value, (_, spans) in zip(some, texts, all_spans(field, texts)):
                    if spans:
                        new[int(r)] = replaced(value, spans)
            if new:
                values = column.to_pylist()
                for r, value in new.items():
                    values[r] = value
                column = pa.array(values, column.type)
            yield pa.RecordBatch.from_arrays([column if i == place else c for i, c in enumerate(batch.columns)], names=names)

    return docs.mapInArrow(run, docs.schema)


def replaced(text: str, spans: list[Span]) -> str:
    out, done = [], 0
    for a, k, b in spans:
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])
