"""Toxicity by non-negative positive-unlabelled learning (operator 2).

Confirmed toxic documents are the positives; a sample of all documents that
may be learnt from is the unlabelled set, whatever its labels. A linear model
over byte 4- and 5-grams is trained in numpy to lower

    prior * risk(positives, +) + max(0, risk(unlabelled, -) - prior * risk(positives, -))

where the second part estimates the risk of the unseen negatives. Where a
minibatch makes that part negative (the model has begun to fit the
unlabelled positives as negatives), its gradient step is reversed. The loss
is the sigmoid of the negative margin.

The fit uses a bounded sample (``POSITIVES`` and ``UNLABELLED`` rows, by hash
order of the id); scoring reads every whole text.

Null, empty and very short texts have no n-grams and get the model's base
score. A document without a doc_id is scored and never learnt from. Rows are
scored one by one, so ties and repeated rows do not matter; several labels of
one document count as toxic if one is. With no positives at all every score
is 0. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nutrilake.llm.textbytes import U64, Texts, mix64, texts_of
from nutrilake.session import materialize

GRAMS = (4, 5)
#: Standard errors that a gram's document frequencies must lie apart to become a feature.
LEAST_Z = 4.0
#: Bounds of the sample that the classifier is fitted on, and of its features.
POSITIVES, UNLABELLED, FEATURES = 4000, 12000, 1024
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """The rows whose labels may not be learnt from: crc32 of the id's text divides by FOLDS."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Model(NamedTuple):
    grams: np.ndarray  # sorted codes
    weights: np.ndarray
    bias: float


def grams_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The code (below 2^41) of every byte n-gram within a document, and its document."""
    codes, docs = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    size = np.diff(texts.off)
    for length in GRAMS:
        n = len(texts.data) - length + 1
        if n <= 0:
            continue
        code = np.zeros(n, U64)
        for j in range(length):
            code = (code << U64(8)) | texts.data[j: j + n]
        if length == GRAMS[0]:
            code |= U64(1 << 40)
        inside = np.ones(n, bool)
        for end in texts.off[1:-1]:
            inside[max(0, end - length + 1): end] = False
        codes.append(code[inside])
        docs.append(np.repeat(np.arange(texts.n), np.maximum(size - length + 1, 0)))
    return np.concatenate(codes), np.concatenate(docs)


def lowered(column: pa.Array) -> Iterator[Texts]:
    return texts_of(pc.utf8_lower(column))


def matches(model: Model, texts: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and features of the model's grams, once a document each. ``table``: the hashes that a gram may have."""
    code, doc = grams_of(texts)
    near = np.flatnonzero(table[(mix64(code) >> U64(44)).astype(np.int64)])
    code, doc = code[near], doc[near]
    at = np.minimum(np.searchsorted(model.grams, code), len(model.grams) - 1)
    true = model.grams[at] == code
    pair = np.unique(doc[true] * len(model.grams) + at[true])
    return pair // len(model.grams), pair % len(model.grams)


def hash_table(grams: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 20, bool)
    table[(mix64(grams) >> U64(44)).astype(np.int64)] = True
    return table


def training_sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """``text`` and ``positive``: confirmed toxic documents and, on their own, documents of any kind, none of them held out."""
    def first(ids: DataFrame, n: int) -> DataFrame:
        return ids.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct() \
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    picked = first(labels.where("toxic = 1"), positives).withColumn("positive", F.lit(True)) \
        .unionByName(first(docs, unlabelled).withColumn("positive", F.lit(False)))
    # At most positives + unlabelled ids, one row each; rows that share an id are merged before they are shuffled.
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text")) \
        .select("text", "positive").repartition(32)


def select_grams(sample: DataFrame, features: int) -> np.ndarray:
    """The n-grams whose document frequencies among positives and unlabelled texts differ most, in standard errors."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positive = batch.column(1).to_numpy(zero_copy_only=False)
            for texts in lowered(batch.column(0)):
                code, doc = grams_of(texts)
                seen = np.unique((doc.astype(U64) << U64(41)) | code)
                gram, where = np.unique(seen & U64((1 << 41) - 1), return_inverse=True)
                plus = positive[texts.lo + (seen >> U64(41)).astype(np.int64)]
                yield pa.RecordBatch.from_pydict({
                    "gram": gram.view(np.int64), "p": np.bincount(where, plus, len(gram)).astype(np.int64),
                    "u": np.bincount(where, ~plus, len(gram)).astype(np.int64)})

    sizes = sample.groupBy().agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).first()
    n_p, n_u = max(sizes["p"], 1), max(sizes["u"], 1)
    p, u = F.col("p") / n_p, F.col("u") / n_u
    pooled = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    z = F.abs(p - u) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    best = sample.mapInArrow(count, "gram long, p long, u long").groupBy("gram").agg(F.sum("p").alias("p"), F.sum("u").alias("u")) \
        .where((F.col("p") + F.col("u") >= 5) & (z >= LEAST_Z)).orderBy(z.desc(), "gram").limit(features).select("gram").collect()
    return np.sort(np.array([r["gram"] for r in best], np.int64).view(U64))


def sample_matrix(sample: DataFrame, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sample as 0/1 features and its positive flags (bounded by the sample's size)."""
    shell, table = Model(grams, np.zeros(0), 0.0), hash_table(grams)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positive = batch.column(1)
            for texts in lowered(batch.column(0)):
                doc, feature = matches(shell, texts, table)
                rows = np.zeros((texts.n, len(grams)), np.uint8)
                rows[doc, feature] = 1
                packed = np.packbits(rows, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in packed]), positive.slice(texts.lo, texts.n)],
                                                 names=["bits", "positive"])

    rows = sample.mapInArrow(features, "bits binary, positive boolean").collect()
    bits = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1)
    x = np.unpackbits(bits, axis=1, count=len(grams))
    y = np.array([r["positive"] for r in rows], bool)
    order = np.lexsort([*bits.T[:32], y])  # the same rows in the same order, however they arrived
    return x[order], y[order]


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, epochs: int = 60, batch: int = 512, rate: float = 0.02,
             decay: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model that lowers the non-negative risk (sigmoid loss, Adam)."""
    rng = np.random.default_rng(seed)
    xp, xu = x[positive], x[~positive]
    w = np.zeros(x.shape[1] + 1)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    w[-1] = np.log(prior / (1 - prior))

    def slope(rows: np.ndarray, sign: int) -> tuple[np.ndarray, float]:
        """Gradient and value of the mean sigmoid loss of the rows with the given label."""
        a = np.concatenate([rows, np.ones((len(rows), 1), rows.dtype)], axis=1).astype(np.float64)
        loss = 1 / (1 + np.exp(np.clip(sign * (a @ w), -50, 50)))
        return -sign * (a.T @ (loss * (1 - loss))) / len(rows), float(loss.mean())

    share = min(0.5, max(0.1, len(xp) / max(1, len(x))))
    n_p = max(1, int(batch * share))
    for _ in range(epochs):
        for lo in range(0, len(xu), batch - n_p):
            u = xu[rng.integers(0, len(xu), batch - n_p)]
            p = xp[rng.integers(0, len(xp), n_p)]
            (gp, _), (gn, rn), (gu, ru) = slope(p, 1), slope(p, -1), slope(u, -1)
            negative = ru - prior * rn
            g = prior * gp + gu - prior * gn if negative >= 0 else prior * gn - gu
            g[:-1] += decay * w[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
          features: int = FEATURES) -> Model | None:
    """The model; None without positives. The class prior is the toxic share of all labels that may be learnt from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0]
    if not prior:
        return None
    sample = materialize(training_sample(docs, known, positives, unlabelled))
    grams = select_grams(sample, features)
    x, positive = sample_matrix(sample, grams) if len(grams) else (np.zeros((0, 0), np.uint8), np.zeros(0, bool))
    if not positive.any() or positive.all():
        return None
    weights, bias = fit_nnpu(x, positive, min(max(prior, 1e-3), 0.5))
    return Model(grams, weights, bias)


def score(docs: DataFrame, model: Model | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    table = hash_table(model.grams) if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0)]
            for texts in lowered(batch.column(1)):
                if model is None:
                    found.append(np.zeros(texts.n))
                    continue
                doc, feature = matches(model, texts, table)
                value = model.bias + np.bincount(doc, model.weights[feature], texts.n)
                found.append(1 / (1 + np.exp(-np.clip(value, -50, 50))))
            got = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), pa.array((got >= 0.5).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    scored = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
