"""Whitening against NumPy on the distinct integer vectors."""

import math

import numpy as np
import pytest

from nutrilake.llm import whitening
from tests.conftest import SF_ORACLE
from tests.llm.test_llm import read

SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, n string"


def by_numpy(vectors, most=4):
    """vec_id -> (deviation, whitened by component up to sign), n, and explained of each component."""
    whole = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(c * n - s) / n for c, s in zip(x, sums)] for x in fit])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    out = {}
    for i, x in whole:
        c = np.array([(a * n - s) / n for a, s in zip(x, sums)])
        out.setdefault(i, []).append((sum((a * n - s) ** 2 for a, s in zip(x, sums)), c @ axes / np.sqrt(values)))
    return out, n, values / np.trace(cov)


def check(rows, vectors):
    want, n, explained = by_numpy(vectors)
    sign = {}
    assert len(rows) == 4 * sum(map(len, want.values()))
    for r in rows:
        deviation, w = want[r.vec_id][0]
        assert (r.n, r.deviation) == (n, deviation) and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9
        w = w[r.component - 1]
        if abs(w) > 1e-6:
            assert sign.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
        assert abs(r.whitened) == pytest.approx(abs(w), abs=1e-8)


def test_whitening_equals_numpy(spark):
    vectors = read(spark, "embeddings", SF_ORACLE)
    check(whitening.whiten(vectors).collect(), [(r.vec_id, r.embedding) for r in vectors.collect()])


def test_whitening_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    monkeypatch.setattr(whitening, "COLUMNS", 5)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 3)
    rng = np.random.default_rng(3)
    vectors = [(i, [float(c) for c in rng.normal(size=12).astype(np.float32) * np.arange(1, 13)]) for i in range(200)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(300)]
    frame = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in vectors], SCHEMA).repartition(7)
    check(whitening.whiten(frame).collect(), vectors)


def test_whitening_awkward(spark):
    broken = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [])]
    frame = spark.createDataFrame([(i, v, None, "x", "y") for i, v in broken], SCHEMA)
    assert whitening.whiten(frame).isEmpty() and whitening.whiten(frame.limit(0)).columns == whitening.whiten(frame).columns
    # Vectors on a line, of another length, and without an id; two components of which one has variance.
    more = broken + [(None, [1.0, 2.0]), (6, [2.0, 4.0]), (6, [2.0, 4.0]), (7, [-3.0, -6.0]), (8, [-0.0, 0.0, 5.0])]
    rows = whitening.whiten(spark.createDataFrame([(i, v, None, "x", "y") for i, v in more], SCHEMA)).collect()
    assert len(rows) == 2 * 4 + 3
    for r in rows:
        if r.vec_id == 8:
            assert (r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None)
        else:
            assert r.n == 3 and r.identity_error < 1e-9 and (r.whitened is None) == (r.component == 2)
    ones = [r for r in rows if r.vec_id != 8 and r.component == 1]
    assert [r.explained for r in ones] == pytest.approx([1.0] * 4)
    assert sum(r.whitened ** 2 for r in {r.vec_id: r for r in ones}.values()) == pytest.approx(3)
    far = spark.createDataFrame([(1, [1e30, 0.0], None, "x", "y"), (2, [-1e30, 1.0], None, "x", "y")], SCHEMA)
    assert {r.deviation for r in whitening.whiten(far).collect()} == {None}
