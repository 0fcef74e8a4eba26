"""Bounded memory changes no result: darts by blocks of cells, remembered strings, centroids by blocks."""

import numpy as np
import public_tokenizers

from nutrilake.llm import bpe, embeddings, minhash


def test_darts_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    doc = np.sort(rng.integers(0, 20, 900))
    element, weight = rng.integers(1, 1 << 62, 900).astype(np.uint64), rng.integers(1, 4, 900).astype(float)
    weight[::7] += 0.5
    whole = minhash.dart_signatures(doc, element, weight, 21, 64)
    for cells in (1, 50, 1000):
        monkeypatch.setattr(minhash, "CELLS", cells)
        assert (minhash.dart_signatures(doc, element, weight, 21, 64) == whole).all()
    assert whole[:20].all() and not whole[20].any()


def test_remembered_strings_are_bounded_in_bytes():
    codec = bpe.ByteBpe(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    codec.runs.most = codec.pieces.most = 20_000
    texts = [f"{'汉字' * 300}{i} word{i} and {'x' * 500}{i}" for i in range(200)]
    got = [np.frombuffer(x, "<u4") for x in codec.encode(texts)]
    assert [codec.decode(x) for x in got] == [t.encode() for t in texts]
    for kept in (codec.runs, codec.pieces):
        held = {**kept.old, **kept.new}
        assert held and all(len(k) <= bpe.LONGEST_KEPT for k in held)
        assert sum(bpe.ENTRY_BYTES + len(k) + len(v) for k, v in kept.new.items()) == kept.bytes <= kept.most + 3000


def test_centroids_in_blocks(monkeypatch):
    x = np.random.default_rng(2).normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    whole = embeddings.spherical_kmeans(x, 12)
    monkeypatch.setattr(embeddings, "PRODUCTS", 100)
    assert np.allclose(embeddings.spherical_kmeans(x, 12), whole)
