"""The skip-chain field: marginals against enumeration, many spans in linear time, and the sample's bounds."""

import itertools
import time

import numpy as np
import pytest

from nutrilake.llm import pii

DOCS = "doc_id long, text string"


def by_enumeration(field, shapes, held, chain, skip):
    weights = np.zeros((len(shapes), pii.LABELS))
    for labels in itertools.product(*([h] if h else range(pii.LABELS) for h in held)):
        score = sum(field.unary[s, y] for s, y, h in zip(shapes, labels, held) if not h)
        score += sum(field.chain[labels[a], labels[b]] for a, b in chain) + sum(field.skip[labels[a], labels[b]] for a, b in skip)
        for i, y in enumerate(labels):
            weights[i, y] += np.exp(score)
    return weights / weights.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("seed", range(8))
def test_marginals_of_trees_are_exact(seed):
    rng = np.random.default_rng(seed)
    n = 2 + seed % 6
    field = pii.Field(rng.normal(size=(6, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)))
    shapes, held = rng.integers(0, 6, n), np.where(rng.random(n) < 0.2, rng.integers(1, pii.LABELS, n), 0)
    edges = [(int(rng.integers(0, i)), i) for i in range(1, n)]
    chain, skip = np.array(edges[::2], np.int64).reshape(-1, 2), np.array(edges[1::2], np.int64).reshape(-1, 2)
    got = pii.marginals(field, shapes, held, chain, skip, rounds=80)
    assert got == pytest.approx(by_enumeration(field, shapes, held, chain, skip), abs=1e-6)


@pytest.mark.parametrize("seed", range(8))
def test_marginals_of_loops_are_close(seed):
    rng = np.random.default_rng(100 + seed)
    n = 4 + seed % 4
    # Potentials of the kind that is learnt: a repeated token has the label of its other occurrence.
    field = pii.Field(rng.normal(size=(6, pii.LABELS)), 0.3 * rng.normal(size=(pii.LABELS, pii.LABELS)), 1.0 * np.eye(pii.LABELS))
    shapes, held = rng.integers(0, 6, n), np.zeros(n, np.int64)
    held[0] = 1 + seed % (pii.LABELS - 1)
    chain = np.array([(i, i + 1) for i in range(n - 1)])
    skip = np.array([(0, 2), (0, n - 1)])
    got, want = pii.marginals(field, shapes, held, chain, skip, rounds=80), by_enumeration(field, shapes, held, chain, skip)
    assert np.abs(got - want).max() < 0.1
    sure = want.max(axis=1) > 0.6
    assert (got.argmax(axis=1) == want.argmax(axis=1))[sure].all()


def test_a_megabyte_of_addresses():
    text = " ".join(f"10.{i % 250}.{i // 250 % 250}.7 +1 (988) 555-{i % 9000 + 1000}" for i in range(36_000))
    began = time.perf_counter()
    spans = pii.base_spans(text)
    nodes = pii.nodes_of(text, spans)
    assert len(text) > 1_000_000 and time.perf_counter() - began < 10
    assert sum(label == 2 for label in nodes.label) == sum(s[1] == 1 for s in spans)
    slow = [next((k + 1 for a, k, b in spans[:200] if a < hi and b > lo), 0) for lo, hi in zip(nodes.start[:80], nodes.end[:80])]
    assert nodes.label[:80] == slow


def test_labels_of_overlapping_spans():
    text = "4111 1111 1111 1111 +49 (30) 1234567 ip 1.2.3.4 a@b.cd4 1.2.3.4@h.io +1 22.33.44.55 99"
    spans = pii.base_spans(text)
    nodes = pii.nodes_of(text, spans)
    assert nodes.label == [next((k + 1 for a, k, b in spans if a < hi and b > lo), 0) for lo, hi in zip(nodes.start, nodes.end)] and any(nodes.label)


def test_sample_is_one_row_an_id(spark):
    base = [(i, f"Call +1 (988) 555-{1000 + i} or 10.0.0.{i}") for i in range(40)]
    same = spark.createDataFrame(base, DOCS)
    many = spark.createDataFrame(base + base[:3] * 500, DOCS).repartition(4)
    a, b = pii.learn_field(same), pii.learn_field(many)
    assert all((x == y).all() for x, y in zip(a, b))
    long = spark.createDataFrame([(1, " ".join(f"10.0.0.{i % 99}" for i in range(9000)))], DOCS)
    assert all(np.isfinite(p).all() for p in pii.learn_field(long))
    nodes = pii.first_nodes(pii.nodes_of("1.2.3.4 5.6.7.8 1.2.3.4 9", []), 2)
    assert len(nodes.start) == 2 and nodes.chain == [(0, 1)] and nodes.skip == []
