"""The forest by gain ratio against a plain recursive one: splits, out-of-bag votes, both phases, missing values and empty tables."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nutrilake.operators import gainforest as G

SCHEMA = "id long, a double, b double, c double, d double, y string"
FEATURES = ["a", "b", "c", "d"]


def entropy(counts):
    n = sum(counts)
    return -sum(c / n * math.log(c / n) for c in counts if c) if n else 0.0


def best_split(rows, drawn, n_classes, bins):
    """rows: (bins, label, weight). The best (feature, last bin on the left, missing left) by plain loops, or None."""
    def counts(part):
        out = [0] * n_classes
        for _, y, w in part:
            out[y] += w
        return out
    total = counts(rows)
    n, found = sum(total), []
    for place, f in enumerate(drawn):
        missing = any(x[f] == bins for x, _, _ in rows)
        missing_drawn = any(x[g] == bins for x, _, _ in rows for g in drawn)
        for t in range(bins):
            for side in (False, True) if missing_drawn else (False,):
                left = counts([r for r in rows if (side if r[0][f] == bins else r[0][f] <= t)])
                right = [a - b for a, b in zip(total, left)]
                nl, nr = sum(left), sum(right)
                gain = n * entropy(total) - nl * entropy(left) - nr * entropy(right) if nl and nr else 0.0
                if gain > 1e-9:
                    found.append((gain, gain / (n * entropy([nl, nr])), place, t, side, missing))
    if not found:
        return None
    average = sum(g for g, *_ in found) / len(found)
    ratio, place, t, side = max(((round(r, 9), -place, -t, -side) for g, r, place, t, side, _ in found if g >= average * (1 - 1e-9)))
    return drawn[-place], -t, bool(-side)


def test_best_splits_equal_plain_loops():
    rng = np.random.default_rng(1)
    for trial in range(200):
        bins, n_classes, n_features = int(rng.integers(2, 6)), int(rng.integers(2, 4)), int(rng.integers(1, 4))
        rows = [(tuple(int(v) for v in rng.integers(0, bins + (trial % 3 > 0), n_features)), int(rng.integers(n_classes)), int(rng.integers(1, 3))) for _ in range(int(rng.integers(1, 25)))]
        hist = np.zeros((1, n_features, bins + 1, n_classes))
        for x, y, w in rows:
            for f, v in enumerate(x):
                hist[0, f, v, y] += w
        found, place, last, side = G.best_splits(hist)
        want = best_split(rows, range(n_features), n_classes, bins)
        assert found[0] == (want is not None)
        if want:
            assert (place[0], last[0], side[0]) == want


def table(spark, n, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = [None if rng.random() < 0.15 else float(np.round(rng.normal(), 1)) for _ in FEATURES]
        y = "z" if x[0] is None or x[0] > 0.4 else "x" if (x[1] or 0) < 0 else "y"
        rows.append((i, *x, None if rng.random() < 0.05 else y if rng.random() < 0.9 else "x"))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_forest_votes(forest, data, out_of_bag):
    """Votes of a recursive forest with the same bags and draws."""
    rows = [(r.h, tuple(r.bins), r.label) for r in data.select(*forest.binned("id", F.col("y"))).collect()]
    n_drawn, n_classes = max(1, round(math.sqrt(len(FEATURES)))), len(forest.classes)
    out = Counter()
    for tree in range(forest.trees):
        weight = G.bag_weights(np.array([h for h, _, _ in rows]), tree, forest.seed)

        def leaf_votes(name, inside, asked):
            total = [0] * n_classes
            for _, y, w in inside:
                total[y] += w
            drawn = [int(f) for f in G.drawn_features(np.array([name], np.uint64), len(FEATURES), n_drawn)[0]]
            split = best_split(inside, drawn, n_classes, G.BINS) if sum(c > 0 for c in total) > 1 else None
            if split is None:
                for h, _ in asked:
                    out[h, total.index(max(total))] += 1
                return
            f, t, side = split
            names = [s[0] for s in G.sides(np.array([name], np.uint64))]
            for name_, goes in zip(names, (True, False)):
                def here(x):
                    return (side if x[f] == G.BINS else x[f] <= t) == goes
                leaf_votes(name_, [r for r in inside if here(r[0])], [a for a in asked if here(a[1])])
        leaf_votes(G.root_of(tree, forest.seed), [(x, y, int(w)) for (_, x, y), w in zip(rows, weight) if w and y >= 0],
                   [(h, x) for (h, x, _), w in zip(rows, weight) if not (out_of_bag and w)])
    return {h: [out[h, c] for c in range(n_classes)] for h, _, _ in rows}


@pytest.mark.parametrize("out_of_bag", [True, False])
def test_votes_equal_a_plain_forest(spark, out_of_bag):
    data = table(spark, 150)
    forest = G.fit(data, FEATURES, "y", "id", trees=7, seed=3)
    got = {r.h: r.votes for r in G.votes(forest, data, "id", out_of_bag).select(F.xxhash64("id").alias("h"), "votes").collect()}
    assert got == plain_forest_votes(forest, data, out_of_bag)


def test_phases_make_the_same_trees(spark):
    data = table(spark, 600)
    whole = G.fit(data, FEATURES, "y", "id", trees=6)
    parts = G.fit(data, FEATURES, "y", "id", trees=6, local_rows=40)
    assert not any(whole.tops) and all(len(t) > 5 for t in parts.tops) and parts.subtrees.count() > whole.subtrees.count() == 6
    asked = table(spark, 900, seed=9)
    a, b = ({r.id: r.votes for r in G.votes(f, asked, "id").collect()} for f in (whole, parts))
    assert a == b and all(sum(v) == 6 for v in a.values())


def test_out_of_bag_rows_and_depth(spark):
    data = table(spark, 400)
    forest = G.fit(data, FEATURES, "y", "id", trees=20)
    told = G.predicted(G.votes(forest, data, "id", out_of_bag=True), forest.classes).collect()
    hashes = np.array([r.h for r in data.select(F.xxhash64("id").alias("h")).collect()])
    lacking = sum((G.bag_weights(hashes, t, forest.seed) == 0).sum() for t in range(20))
    assert sum(r.n_votes for r in told) == lacking and 0.3 < lacking / (20 * 400) < 0.44
    right = [r for r in told if r.y is not None and r.prediction == r.y]
    assert len(right) / len(told) > 0.7
    # A chain that only a deep tree tells apart.
    deep = spark.createDataFrame([(i, float(i % 31), 0.0, 0.0, 0.0, "xy"[i % 31 % 2]) for i in range(620)], SCHEMA)
    told = G.predicted(G.votes(G.fit(deep, ["a"], "y", "id", trees=9), deep, "id"), ["x", "y"])
    assert told.where("prediction <> y").isEmpty()


def test_forest_of_nothing(spark):
    data = table(spark, 20)
    none = G.fit(data.limit(0), FEATURES, "y", "id", trees=3)
    told = G.predicted(G.votes(none, data, "id"), none.classes)
    assert told.count() == 20 and told.where("prediction is not null or n_votes > 0").isEmpty()
    one = G.fit(data.withColumn("y", F.lit("x")), FEATURES, "y", "id", trees=3)
    assert {r.votes[0] for r in G.votes(one, data, "id").collect()} == {3}
    assert G.votes(one, data.limit(0), "id").count() == 0
    twice = data.unionByName(data)
    assert G.votes(one, twice, "id", out_of_bag=True).count() == 40
