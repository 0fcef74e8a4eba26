"""The forest by information gain: its trees stay a table, both phases make the same ones, repeated rows count as often as they come."""

import numpy as np
import pytest

from nutrilake.operators import forest
from nutrilake.operators import gainforest as G
from tests.test_gainforest import FEATURES, table


def told(model, rows):
    return {r.id: (r.prediction, round(r.confidence, 9)) for r in forest.predict(model, rows, FEATURES, "y").collect()}


@pytest.fixture(scope="module")
def fitted(spark):
    data = table(spark, 600)
    return data, *(forest.fit_forest(data, FEATURES, "y", num_trees=6, local_rows=n) for n in (10_000, 40))


def test_phases_make_the_same_forest(spark, fitted):
    data, whole, parts = fitted
    assert not any(whole.forest.tops) and all(len(t) > 5 for t in parts.forest.tops) and parts.forest.subtrees.count() > 6
    asked = table(spark, 900, seed=9)
    assert told(whole, asked) == told(parts, asked)
    for what in (lambda m: forest.feature_importances(spark, m, FEATURES), lambda m: forest.split_statistics(m, FEATURES)):
        a, b = (sorted(what(m).collect()) for m in (whole, parts))
        assert {x[0] for x in a} <= {*FEATURES, *(f"{c}__missing" for c in FEATURES)}
        assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1:] for x in a], [x[1:] for x in b])
    assert abs(sum(r.importance for r in forest.feature_importances(spark, whole, FEATURES).collect()) - 1) < 1e-9
    rows = forest.predict(whole, data, FEATURES, "y").where("y is not null").collect()
    assert sum(r.y == r.prediction for r in rows) > 0.9 * len(rows)
    assert all(abs(r.p_x + r.p_y + r.p_z - 1) < 1e-9 and r.confidence == max(r.p_x, r.p_y, r.p_z) for r in rows)


def test_saved_forest_is_the_same(spark, fitted, tmp_path):
    data, _, parts = fitted
    parts.save(f"{tmp_path}/model")
    assert told(forest.ForestModel.load(spark, f"{tmp_path}/model"), data) == told(parts, data)


def test_nodes_stay_off_the_driver(fitted):
    """The driver holds the splits above the groups only, whatever the trees' sizes: at most about 2 x trees x rows / local_rows."""
    _, whole, parts = fitted
    nodes = sum(len(G.pickle.loads(r.blob).feature) for r in whole.forest.subtrees.select("blob").collect())
    assert nodes > 6 * 50 and sum(map(len, whole.forest.tops)) == 0
    assert sum(map(len, parts.forest.tops)) < 4 * 6 * 600 / 40


def test_repeated_rows_count_as_often_as_they_come(spark):
    rows = [(1.0, "x")] * 300 + [(1.0, "y")] * 100 + [(2.0, "y")] * 50
    data = spark.createDataFrame([(i, a, y) for i, (a, y) in enumerate(rows)], "id long, a double, y string")
    model = forest.fit_forest(data, ["a"], "y", num_trees=20)
    assert model.forest.rows == 3
    got = {(r.a, r.prediction, round(r.p_x, 1)) for r in forest.predict(model, data, ["a"], "y").collect()}
    assert got in ({(1.0, "x", 0.7), (2.0, "y", 0.0)}, {(1.0, "x", 0.8), (2.0, "y", 0.0)})
    h = np.arange(4000)
    for n in (1, 2, 40):
        w = G.bag_weights(h, 0, 7, np.full(4000, n))
        assert abs(w.mean() - n) < 0.06 * n and abs(w.var() - n) < 0.15 * n


def test_growth_by_gain_equals_plain_loops():
    rng = np.random.default_rng(5)
    for trial in range(100):
        bins, n_features, n = 5, int(rng.integers(1, 4)), int(rng.integers(2, 25))
        x, y, w = rng.integers(0, bins, (n, n_features)).astype(np.uint8), rng.integers(0, 2, n), rng.integers(1, 3, n)
        tree = G.grow(x, y, w, G.root_of(0, trial), bins, 2, n_features, by_ratio=False, depth=1)

        def left_entropy(f, t):
            parts = [np.bincount(y[s], w[s], 2) for s in (x[:, f] <= t, x[:, f] > t)]
            return sum(p.sum() * -(q[q > 0] * np.log(q[q > 0])).sum() for p in parts if p.sum() for q in [p / p.sum()])
        whole = left_entropy(0, bins)
        best = max(((round((whole - left_entropy(f, t)) / w.sum(), 9), -f, -t) for f in range(n_features) for t in range(bins)))
        assert (tree.feature[0] >= 0) == (best[0] > 1e-9)
        if best[0] > 1e-9:
            assert len(tree.feature) == 3 and (tree.feature[0], tree.bin[0]) == (-best[1], -best[2])
        deep = G.grow(x, y, w, G.root_of(0, trial), bins, 2, n_features, by_ratio=False)
        pruned = G.grow(x, y, w, G.root_of(0, trial), bins, 2, n_features, by_ratio=False, prune=True)
        assert (deep.counts.argmax(1)[deep.place_of(x, bins)] == pruned.counts.argmax(1)[pruned.place_of(x, bins)]).all()
        kids = pruned.child[pruned.feature >= 0]
        assert all(pruned.feature[k] >= 0 or pruned.feature[k + 1] >= 0 or pruned.counts[k].argmax() != pruned.counts[k + 1].argmax() for k in kids)


def test_predicted_rows_are_not_gathered_on_the_driver(spark, fitted):
    """Rows that derive from a small file may be many: their join with the votes is no broadcast."""
    data, whole, _ = fitted
    plan = forest.predict(whole, data, FEATURES, "y")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
