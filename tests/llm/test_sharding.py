"""The hash tree: laws of movement and weight, slots, and the written shards."""

import dataclasses
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nutrilake.llm import hashtree
from tests.llm.test_llm import AWKWARD, awkward


def test_weights_and_movement(spark):
    tree = [hashtree.Leaf(i, (f"r{i // 6}", f"k{i // 3 % 2}"), weight=1 + i % 3) for i in range(12)]
    heavier = [dataclasses.replace(leaf, weight=6) if leaf.shard == 4 else leaf for leaf in tree]
    lighter = [dataclasses.replace(leaf, weight=0) if leaf.shard == 4 else leaf for leaf in tree]
    bigger = hashtree.grown(hashtree.grown(tree, ("r0", "k1"), 12), ("r1", "k0"), 13, weight=2)
    docs = spark.range(60_000).withColumnRenamed("id", "doc_id")
    for name, t in [("at", tree), ("heavier", heavier), ("lighter", lighter), ("bigger", bigger)]:
        docs = hashtree.placed(docs, t, name=name)
    rows = docs.collect()
    for name, t in [("at", tree), ("heavier", heavier), ("lighter", lighter), ("bigger", bigger)]:
        total, count = sum(leaf.weight for leaf in t), Counter(r[name] for r in rows)
        for leaf in t:
            want = 60_000 * leaf.weight / total
            assert abs(count[leaf.shard] - want) <= 5 * want ** 0.5 + 1
    path = {leaf.shard: leaf.path for leaf in tree}
    for r in rows:
        if r.heavier != r.at:  # into the heavier region, rack or shard, whichever it had not yet reached
            assert path[r.heavier][0] == "r0" and (path[r.at][0] != "r0" or path[r.heavier][1] == "k1" and (path[r.at][1] != "k1" or r.heavier == 4))
        if r.lighter != r.at:  # out of the lighter region, rack or shard
            assert path[r.at][0] == "r0" and (path[r.lighter][0] != "r0" or path[r.at][1] == "k1" and (path[r.lighter][1] != "k1" or r.at == 4))
        assert r.bigger == r.at or r.bigger in (12, 13)


def test_tree_is_checked():
    for bad in ([hashtree.Leaf(0, ("a",)), hashtree.Leaf(0, ("b",))], [hashtree.Leaf(0, ("a",)), hashtree.Leaf(1, ("b", "c"))], [hashtree.Leaf(0, ("a",), -1.0)]):
        with pytest.raises(ValueError):
            hashtree.nodes_of(bad)


def test_sharding_awkward(spark):
    docs = awkward(spark, AWKWARD + [(77, "same", "en", "a", 1)] * 500 + [(None, "none", "en", "a", 1)] * 300)
    rows = hashtree.sharded(docs, hashtree.TREE, hashtree.BIGGER).collect()
    assert len(rows) == len(AWKWARD) + 800
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in AWKWARD + [(77, "same")] * 500 + [(None, "none")] * 300)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len({r.shard for r in rows if r.doc_id == i}) == 1 for i in {r.doc_id for r in rows})
    assert hashtree.sharded(docs.limit(0), hashtree.TREE).isEmpty()


def test_written_shards(spark, tmp_path):
    docs = awkward(spark)
    hashtree.write_shards(docs, hashtree.TREE, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert Counter(map(tuple, back.select(*docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    assert back.where(F.col("shard") != hashtree.shard_of(hashtree.id_key(F.col("doc_id")), hashtree.TREE)).isEmpty()
