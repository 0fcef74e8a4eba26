"""Random forest whose trees stay tables: by gain ratio with a learnt side for missing values, without a depth cap (M1, M2), with
out-of-bag votes (M3); or by information gain, with a depth cap and pruned leaves (``forest.py``).

Features are binned at quantiles of the training rows. A row's weight in a
tree's bag is Poisson by a hash of the row and the tree, so that bags need no
memory: weight 0 means out of bag. Every node draws about the root of the number of features
anew, by a hash of the node.

Trees grow in two phases. While a node holds more than ``local_rows`` rows, its
split comes from one histogram over (drawn feature, bin, class) a level: each task
adds up its rows, one group a node adds up the tasks. A smaller node's rows meet in one group, which
grows the rest of the tree, level by level, by the same rule; node names are
hashes of the way to them, so that both phases make the same tree. On
the driver are only the splits above the groups, at most about 2 x trees x rows / ``local_rows``.
Rows travel packed, one record a batch, tree and group.

By gain ratio a split is the threshold and the side for missing values with the highest gain
ratio (information gain by the entropy of the two sides' sizes) among those whose gain is not
below the average of the node's candidates; else that of the highest information gain.
A node ends if it is pure or nothing gains. A leaf votes for its heaviest class, ties for the first.

Rows without a label are left out of the fit. Repeated rows (equal keys) share
their bags; without a key, equal rows are one row with the bag of all of its copies. A table without labelled rows
gives a forest without votes.
"""

from __future__ import annotations

import functools
import json
import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nutrilake.session import materialize

BINS, LOCAL_ROWS = 32, 200_000
#: (Node, drawn feature, bin) cells that a block of nodes holds at once, and histogram cells that a task holds before it hands them on.
BLOCK_CELLS, HELD_CELLS = 1 << 19, 1 << 24
#: Rows of a batch that is routed at once, and row-tree pairs a task of the shuffle that follows.
BATCH, PAIRS = 16_384, 200_000
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x).astype(U64) + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


@functools.lru_cache(4096)
def _poisson_steps(mean: int) -> np.ndarray:
    k = np.arange(1, 12 if mean == 1 else int(mean + 12 * math.sqrt(mean) + 30))
    return np.cumsum(np.exp(np.r_[0.0, np.cumsum(np.log(mean / k))] - mean))


def bag_weights(key_hash: np.ndarray, tree: int, seed: int, copies: np.ndarray | None = None) -> np.ndarray:
    """Poisson(1) weights by hash; of a row that stands for several copies, the weight of all of them."""
    u = (mix(key_hash.astype(np.int64).view(U64) ^ mix(U64((seed << 20) + tree))) >> U64(11)) / float(1 << 53)
    weight = np.searchsorted(_poisson_steps(1), u, side="right").astype(np.int64)
    for n in np.unique(copies[copies > 1]) if copies is not None else ():
        at = np.flatnonzero(copies == n)
        weight[at] = np.searchsorted(_poisson_steps(int(n)), u[at], side="right")
    return weight


def root_of(tree: int, seed: int) -> np.uint64:
    return mix(U64((seed << 20) + tree) ^ U64(0xA5A5A5A5))


def sides(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mix(nodes ^ U64(0x1111)), mix(nodes ^ U64(0x2222))


def drawn_features(nodes: np.ndarray, n_features: int, n_drawn: int) -> np.ndarray:
    """The features that each node draws, in rising order."""
    order = mix(nodes[:, None] ^ mix(np.arange(n_features, dtype=U64) + U64(77))[None, :])
    return np.sort(np.argsort(order, axis=1, kind="stable")[:, :n_drawn], axis=1)


@functools.cache
def _known_logs() -> np.ndarray:
    x = np.arange(1 << 17, dtype=float)
    return x * np.log(np.maximum(x, 1.0))


def _xlogx(counts: np.ndarray) -> np.ndarray:
    if counts.size and counts.max() < 1 << 17:
        return _known_logs()[counts.astype(np.int64)]
    return counts * np.log(np.maximum(counts, 1.0))


def _best(key: np.ndarray, counts: np.ndarray, n_drawn: int, n_bins: int, by_ratio: bool) -> tuple[np.ndarray, ...]:
    """Of the filled cells ``key`` ((node, drawn feature, bin), rising; the bin ``n_bins`` is missing) with their weights
    [class, cell]: whether a split gains, the place of its feature, its last bin on the left, whether missing values go
    left, and the weights on the left [class, node]. A threshold without rows of its own counts as the one before it."""
    part, value = np.divmod(key, n_bins + 1)
    there = np.flatnonzero(value < n_bins)
    c, of, v = counts[:, there], part[there], value[there]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    end = np.r_[first[1:], len(there)] - 1
    missing = np.zeros((len(counts), len(first)))
    lacking = value == n_bins
    missing[:, part[lacking]] = counts[:, lacking]
    left = c.cumsum(axis=1)
    left -= (left[:, first] - c[:, first])[:, of]
    whole = left[:, end] + missing
    n = whole.sum(axis=0)
    h_all = _xlogx(n) - _xlogx(whole).sum(axis=0)
    times = np.r_[v[1:], 0]
    times[end] = n_bins
    times = (times - v).astype(float)
    lefts = [left, left + missing[:, of]] if missing.any() else [left]  # without missing values both sides are one split
    gains, scores = [], []
    for x in lefts:
        y = whole[:, of] - x
        n_x, n_y = x.sum(axis=0), y.sum(axis=0)
        log_x, log_y = _xlogx(n_x), _xlogx(n_y)
        gain = h_all[of] - (log_x - _xlogx(x).sum(axis=0)) - (log_y - _xlogx(y).sum(axis=0))
        gain[(n_x <= 0) | (n_y <= 0)] = 0.0
        gains.append(gain)
        scores.append(gain / np.maximum(_xlogx(n)[of] - log_x - log_y if by_ratio else n[of], 1e-12))
    gain, score = np.stack(gains, axis=1), np.stack(scores, axis=1)  # [cell, side]
    useful, start = gain > 1e-9, first[::n_drawn]
    if by_ratio:
        weighed = useful * times[:, None]
        average = np.add.reduceat((gain * weighed).sum(axis=1), start) / np.maximum(np.add.reduceat(weighed.sum(axis=1), start), 1)
        useful &= gain >= (average * (1 - 1e-9))[of // n_drawn][:, None]
    score = np.where(useful, np.round(score, 12), -1.0)
    most = np.maximum.reduceat(score.max(axis=1), start)
    hit = score == most[of // n_drawn][:, None]
    best = np.minimum.reduceat(np.where(hit.any(axis=1), np.arange(len(of)), len(of)), start)
    side = hit[best].argmax(axis=1) == 1
    return most > 0, of[best] % n_drawn, v[best], side, np.where(side, lefts[-1][:, best], left[:, best])


def best_splits(hist: np.ndarray, by_ratio: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of histograms [node, drawn feature, bin and last missing, class]: whether a split gains, the place of its feature,
    its last bin on the left, and whether missing values go left."""
    filled = hist.sum(axis=-1) > 0
    filled[..., 0] = True
    key = np.flatnonzero(filled)
    return _best(key, hist.reshape(-1, hist.shape[-1])[key].T.astype(float), hist.shape[1], hist.shape[2] - 1, by_ratio)[:4]


@dataclass
class Tree:
    """Nodes by place: feature (-1: leaf), last bin on the left, missing to the left, first child (the other follows), class weights [node, class]."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    child: np.ndarray
    counts: np.ndarray

    def place_of(self, bins: np.ndarray, n_bins: int) -> np.ndarray:
        """The leaf that each row reaches."""
        at, moving = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(moving):
            here = at[moving]
            inner = self.feature[here] >= 0
            moving, here = moving[inner], here[inner]
            value = bins[moving, self.feature[here]]
            left = np.where(value == n_bins, self.missing_left[here], value <= self.bin[here])
            at[moving] = self.child[here] + ~left
        return at

    def gains(self) -> tuple[np.ndarray, np.ndarray]:
        """Feature and information gain (nats x weight) of each split."""
        at = np.flatnonzero(self.feature >= 0)
        n = self.counts.astype(float)
        h = _xlogx(n.sum(axis=1)) - _xlogx(n).sum(axis=1)
        return self.feature[at], h[at] - h[self.child[at]] - h[self.child[at] + 1]

    def levels(self, most: int) -> Iterator[np.ndarray]:
        """The features split at each of the first ``most`` levels."""
        at = np.zeros(1, np.int64)
        for _ in range(most):
            at = at[self.feature[at] >= 0]
            yield self.feature[at]
            at = (self.child[at][:, None] + np.arange(2)).ravel()


def _pruned(levels: list[dict]) -> list[dict]:
    """Leaves below one split that vote alike become one leaf, from below; what is no longer reached goes."""
    for up, down in zip(levels[-2::-1], levels[:0:-1]):
        split = np.flatnonzero(up["feature"] >= 0)
        vote, leaf = down["counts"].argmax(axis=0), down["feature"] < 0
        kid = up["kid"][split]
        alike = leaf[kid] & leaf[kid + 1] & (vote[kid] == vote[kid + 1])
        up["feature"][split[alike]] = -1
    kept = [levels[0]]
    for down in levels[1:]:
        up = kept[-1]
        split = np.flatnonzero(up["feature"] >= 0)
        if not len(split):
            break
        kids = (up["kid"][split][:, None] + np.arange(2)).ravel()
        up["kid"][split] = 2 * np.arange(len(split))
        kept.append({k: x[:, kids] if k == "counts" else x[kids] for k, x in down.items()})
    return kept


def grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, root: np.uint64, n_bins: int, n_classes: int, n_drawn: int,
         by_ratio: bool = True, depth: int | None = None, prune: bool = False) -> Tree:
    """The tree below ``root`` over rows of bins (the value ``n_bins`` is missing), to its leaves or ``depth``."""
    def level(names: np.ndarray, counts: np.ndarray) -> dict:
        n = len(names)
        return {"name": names, "feature": np.full(n, -1, np.int16), "bin": np.zeros(n, np.int16), "missing_left": np.zeros(n, bool), "kid": np.zeros(n, np.int64), "counts": counts}

    levels = [level(np.array([root], U64), np.bincount(label, weight, n_classes)[:, None])]
    rows, group = np.arange(len(bins)), np.zeros(len(bins), np.int64)  # rows of open nodes, by open node
    weight = np.asarray(weight, float)
    open_ = np.arange(1)  # places of the open nodes in the last level
    step = max(1, BLOCK_CELLS // (n_drawn * (n_bins + 1)))
    while len(open_) and (depth is None or len(levels) <= depth):
        now = levels[-1]
        names = now["name"][open_]
        drawn = drawn_features(names, bins.shape[1], n_drawn)
        split_of, left_counts, right = [], [], np.zeros(len(rows), bool)
        for lo in range(0, len(open_), step):
            n = min(step, len(open_) - lo)
            s, e = np.searchsorted(group, [lo, lo + n])
            mine, g = rows[s:e], group[s:e] - lo
            values = bins[mine[:, None], drawn[lo + g]].astype(np.int64)
            cell = (g[:, None] * n_drawn + np.arange(n_drawn)) * (n_bins + 1) + values
            filled = np.zeros((n * n_drawn, n_bins + 1), bool)
            filled.ravel()[cell] = True
            filled[:, 0] |= filled[:, n_bins]  # missing values alone on the left
            key = np.flatnonzero(filled)
            number = np.cumsum(filled.ravel()) - 1
            counts = np.bincount((label[mine][:, None] * len(key) + number[cell]).ravel(), np.repeat(weight[mine], n_drawn), n_classes * len(key))
            found, place, last, side, left = _best(key, counts.reshape(n_classes, -1), n_drawn, n_bins, by_ratio)
            value = values[np.arange(len(mine)), place[g]]
            right[s:e] = ~np.where(value == n_bins, side[g], value <= last[g])
            at = np.flatnonzero(found)
            here = open_[lo + at]
            now["feature"][here], now["bin"][here], now["missing_left"][here] = drawn[lo + at, place[at]], last[at], side[at]
            split_of.append(lo + at)
            left_counts.append(left[:, at])
        split = np.concatenate(split_of)
        if not len(split):
            break
        left = np.concatenate(left_counts, axis=1)
        now["kid"][open_[split]] = 2 * np.arange(len(split))
        counts = np.stack([left, now["counts"][:, open_[split]] - left], axis=2).reshape(n_classes, -1)
        levels.append(level(np.column_stack(sides(names[split])).ravel(), counts))
        mixed = (counts > 0).sum(axis=0) > 1
        kid = np.full(len(open_), -2)
        kid[split] = 2 * np.arange(len(split))
        kid = kid[group] + right
        going = np.flatnonzero(kid >= 0)
        going = going[mixed[kid[going]]]
        kid = (np.cumsum(mixed) - 1)[kid[going]]
        rows = rows[going]
        by_kid = np.argsort(kid, kind="stable")
        rows, group, open_ = rows[by_kid], kid[by_kid], np.flatnonzero(mixed)
    if prune:
        levels = _pruned(levels)
    ends = np.cumsum([len(x["feature"]) for x in levels])
    for x, end in zip(levels, ends):
        x["kid"] += end
    joined = {k: np.concatenate([x[k] for x in levels]) for k in ("feature", "bin", "missing_left", "kid")}
    counts = np.concatenate([x["counts"] for x in levels], axis=1).T
    return Tree(joined["feature"], joined["bin"], joined["missing_left"], joined["kid"].astype(np.int32), np.ascontiguousarray(counts.astype(np.min_scalar_type(int(counts.max(initial=0))))))


@dataclass
class Forest:
    """``tops``: for each tree, the splits above the groups (empty in small tables); ``subtrees``: (tree, node, blob), one row a group."""

    features: list[str]
    classes: list[str]
    cuts: list[list[float]]
    trees: int
    seed: int
    rows: int
    subtrees: DataFrame | None
    tops: list[dict] = field(default_factory=list)  # node name -> (feature, bin, missing left)
    closed: list[set] = field(default_factory=list)  # names of the groups met so far

    def binned(self, key: str | Column, label: Column | None = None) -> list[Column]:
        """Key hash, bins as bytes, label number."""
        number = F.lit(-1) if label is None else F.coalesce(F.array_position(F.array(*map(F.lit, self.classes)), label) - 1, F.lit(-1))
        return [F.xxhash64(key).alias("h"), self.bins().alias("bins"), number.cast("int").alias("label")]

    def bins(self) -> Column:
        def bin_of(name: str, cuts: list[float]) -> Column:
            below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(name).cast("double"))) if cuts else F.lit(0)
            return F.when(F.col(name).isNull() | F.isnan(F.col(name).cast("double")), F.lit(BINS)).otherwise(below)
        return F.unhex(F.concat(*(F.lpad(F.hex(bin_of(f, c)), 2, "0") for f, c in zip(self.features, self.cuts))))

    def save(self, path: str) -> None:
        """The trees as a table; beside it, in one row, what the driver holds."""
        about = {k: getattr(self, k) for k in ("features", "classes", "cuts", "trees", "seed", "rows")}
        tops = [[(name, *map(int, split)) for name, split in top.items()] for top in self.tops]
        self.subtrees.write.parquet(f"{path}/trees")
        self.subtrees.sparkSession.createDataFrame([(json.dumps(about | {"tops": tops}),)], "about string").write.parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
        tops = [{name: (f, b, bool(m)) for name, f, b, m in top} for top in about.pop("tops")]
        return Forest(**about, subtrees=spark.read.parquet(f"{path}/trees"), tops=tops)


@dataclass
class Top:
    """The upper part of a tree: its splits, whose leaves are the groups and open nodes, with the name and the level of each place."""

    tree: Tree
    names: np.ndarray
    level: np.ndarray


def _tops(forest: Forest) -> list[Top]:
    out = []
    for number, top in enumerate(forest.tops):
        names, level, nodes = [root_of(number, forest.seed)], [0], []
        for place, name in enumerate(names):  # grows as it goes
            split = top.get(int(name))
            nodes.append((*split, len(names)) if split else (-1, 0, False, 0))
            if split:
                names += [x[0] for x in sides(np.array([name], U64))]
                level += [level[place] + 1] * 2
        feature, cut, missing_left, child = map(np.array, zip(*nodes))
        out.append(Top(Tree(feature, cut, missing_left, child, np.zeros((len(names), 0))), np.array(names, U64), np.array(level)))
    return out


def _arrays(batch: pa.RecordBatch | pa.Table, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column("h")), np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, n_features)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


PACKED = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("bins", pa.binary()), ("label", pa.binary()), ("weight", pa.binary())])
ASKED = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("part", pa.int32()), ("batch", pa.int64()), ("at", pa.binary()), ("bins", pa.binary())])
ANSWERED = pa.schema([("batch", pa.int64()), ("tree", pa.int32()), ("kind", pa.string()), ("at", pa.binary()), ("votes", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def _by_group(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group met, with the positions of its rows."""
    order = np.argsort(place, kind="stable")
    first = np.flatnonzero(np.r_[True, place[order][1:] != place[order][:-1]]) if len(place) else []
    for lo, hi in zip(first, np.r_[first[1:], len(place)]):
        yield place[order[lo]], order[lo:hi]


def _bags(forest: Forest) -> tuple:
    """A function over batches of binned rows (for every slice its number, arrays and, tree by tree, rows of the bag, weights and places in the top); the tops; the number of trees."""
    trees, seed, n_features, tops = forest.trees, forest.seed, len(forest.features), _tops(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator:
        slices = (b.slice(lo, BATCH) for b in batches for lo in range(0, b.num_rows, BATCH))
        for i, batch in enumerate(slices):
            h, bins = _arrays(batch, n_features)
            label, copies = (np.asarray(batch.column(c)) if c in batch.schema.names else None for c in ("label", "copies"))

            def in_tree(tree: int, keep: str = "in", h=h, bins=bins, copies=copies):
                weight = bag_weights(h, tree, seed, copies) if keep != "all" else np.ones(len(h), np.int64)
                at = np.flatnonzero(weight == 0 if keep == "out" else weight > 0)
                return at, weight[at], tops[tree].tree.place_of(bins[at], BINS)
            yield i, h, bins, label, in_tree
    return run, tops, trees


def _top_level(rows: DataFrame, forest: Forest, local_rows: int, n_drawn: int, by_ratio: bool = True, depth: int | None = None) -> int:
    """Splits the nodes of one level that hold more than ``local_rows`` rows; how many were split."""
    n_features, n_classes, done = len(forest.features), len(forest.classes), forest.closed
    run, tops, trees = _bags(forest)
    width = n_drawn * (BINS + 1) * n_classes
    open_of = []  # for each tree the number of each place among the open nodes, or -1
    for tree, top in enumerate(tops):
        is_open = (top.tree.feature < 0) & np.array([int(n) not in done[tree] for n in top.names])
        if depth is not None:
            is_open &= top.level < depth
        open_of.append(np.where(is_open, np.cumsum(is_open) - 1, -1))
    names_of = [top.names[o >= 0] for top, o in zip(tops, open_of)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for tree, (hist, n_rows) in held.items():
                at = np.flatnonzero(n_rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree, np.int32)), pa.array(names_of[tree][at].view(np.int64)), pa.array(n_rows[at]),
                                                  pa.array([hist[i].tobytes() for i in at], pa.binary())], names=["tree", "node", "rows", "hist"])
            held.clear()
        for _, _, bins, label, in_tree in run(batches):
            for tree in range(trees):
                n = len(names_of[tree])
                if not n:
                    continue
                at, weight, place = in_tree(tree)
                node = open_of[tree][place]
                at, weight, node = at[node >= 0], weight[node >= 0], node[node >= 0]
                values = bins[at[:, None], drawn_features(names_of[tree], n_features, n_drawn)[node]].astype(np.int64)
                cell = ((node[:, None] * n_drawn + np.arange(n_drawn)) * (BINS + 1) + values) * n_classes + label[at][:, None]
                hist = np.bincount(cell.ravel(), np.repeat(weight, n_drawn), n * width).astype(np.int64).reshape(n, width)
                n_rows = np.bincount(node, minlength=n).astype(np.int64)
                before = held.get(tree)
                held[tree] = (hist, n_rows) if before is None else (before[0] + hist, before[1] + n_rows)
                if sum(x.size for x, _ in held.values()) > HELD_CELLS:
                    yield from told()
        yield from told()

    def split(group: pa.Table) -> pa.Table:
        hist, n_rows = sum(np.frombuffer(x.as_py(), np.int64) for x in group["hist"]), sum(group["rows"].to_pylist())
        tree, node = group["tree"][0].as_py(), group["node"][0].as_py()
        found, place, last, side = best_splits(hist.reshape(1, n_drawn, BINS + 1, n_classes), by_ratio)
        drawn = drawn_features(np.array([node], np.int64).view(U64), n_features, n_drawn)[0]
        large = n_rows > local_rows
        return pa.table({"tree": [tree], "node": [node], "feature": [int(drawn[place[0]]) if found[0] and large else -1], "bin": [int(last[0])], "side": [bool(side[0])]},
                        schema=pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.int32()), ("bin", pa.int32()), ("side", pa.bool_())]))

    hist = rows.mapInArrow(count, "tree int, node long, rows long, hist binary")
    n = 0
    for r in hist.groupBy("tree", "node").applyInArrow(split, "tree int, node long, feature int, bin int, side boolean").collect():
        name = r.node & (2 ** 64 - 1)
        if r.feature >= 0:
            forest.tops[r.tree][name] = (r.feature, r.bin, r.side)
            n += 1
        else:
            forest.closed[r.tree].add(name)
    return n


def _spread(df: DataFrame, pairs: float, *keys: str) -> DataFrame:
    """Dealt by ``keys`` to tasks of about ``PAIRS`` rows a tree."""
    return df.repartition(int(min(2000, max(df.sparkSession.sparkContext.defaultParallelism, pairs / PAIRS))), *keys)


def cuts_of(data: DataFrame, features: Sequence[str]) -> list[list[float]]:
    points = [i / BINS for i in range(1, BINS)]
    cuts = data.select(*(F.percentile_approx(F.col(f).cast("double"), points, 10_000).alias(f) for f in features)).first()
    return [sorted(set(cuts[f] or [])) for f in features]


def fit(train: DataFrame, features: Sequence[str], label: str, key: str, trees: int = 100, seed: int = 7, local_rows: int = LOCAL_ROWS) -> Forest:
    """The forest over the rows with a label; ``key`` names a row in the bags."""
    data = materialize(train.where(F.col(label).isNotNull()).select(key, label, *features))
    classes = [r[0] for r in data.groupBy(F.col(label).cast("string")).count().collect()]  # one row a class
    forest = Forest(list(features), sorted(classes), cuts_of(data, features), trees, seed, data.count(), None, [{} for _ in range(trees)])
    if not classes:
        return forest
    return grown(forest, materialize(data.select(*forest.binned(key, F.col(label).cast("string")))), max(1, round(math.sqrt(len(features)))), local_rows)


def grown(forest: Forest, rows: DataFrame, n_drawn: int, local_rows: int = LOCAL_ROWS, by_ratio: bool = True, depth: int | None = None, prune: bool = False) -> Forest:
    """Adds the trees to ``forest``. ``rows``: checkpointed, with h, bins and label; ``copies``, if it is there, says for how many rows one stands."""
    n_classes, n_features = len(forest.classes), len(forest.features)
    forest.closed = [set() for _ in range(forest.trees)]
    while forest.rows > local_rows and _top_level(rows, forest, local_rows, n_drawn, by_ratio, depth):
        pass
    run, tops, trees = _bags(forest)
    level_of = [{int(n): int(v) for n, v in zip(top.names, top.level)} for top in tops]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, bins, label, in_tree in run(batches):
            out = []
            for tree in range(trees):
                at, weight, place = in_tree(tree)
                for group, mine in _by_group(place):
                    out.append((tree, int(tops[tree].names[[group]].view(np.int64)[0]), bins[at[mine]].tobytes(),
                                label[at[mine]].astype(np.int32).tobytes(), weight[mine].astype(np.int32).tobytes()))
            yield _batch(out, PACKED)

    def finish(group: pa.Table) -> pa.Table:
        bins = _joined(group["bins"], np.uint8).reshape(-1, n_features)
        number, node = group["tree"][0].as_py(), group["node"][0].as_py()
        name = np.array([node], np.int64).view(U64)[0]
        left = None if depth is None else depth - level_of[number][int(name)]
        tree = grow(bins, _joined(group["label"], np.int32).astype(np.int64), _joined(group["weight"], np.int32), name, BINS, n_classes, n_drawn, by_ratio, left, prune)
        return pa.table({"tree": [number], "node": [node], "blob": [pickle.dumps(tree)], "counts": [tree.counts[0].tolist()], "leaf": [bool(tree.feature[0] < 0)]},
                        schema=pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("blob", pa.binary()), ("counts", pa.list_(pa.int64())), ("leaf", pa.bool_())]))

    packed = _spread(rows.mapInArrow(route, "tree int, node long, bins binary, label binary, weight binary"), forest.rows * trees, "tree", "node")
    forest.subtrees = materialize(packed.groupBy("tree", "node").applyInArrow(finish, "tree int, node long, blob binary, counts array<bigint>, leaf boolean"))
    if prune and any(forest.tops):
        _prune_tops(forest)
    return forest


def _groups(forest: Forest) -> dict[tuple[int, int], tuple[np.ndarray, bool]]:
    """(Tree, name): weights, and whether it is a leaf, of each group's root; there are as many as the tops have ends."""
    return {(r.tree, r.node & (2 ** 64 - 1)): (np.array(r.counts), r.leaf) for r in forest.subtrees.select("tree", "node", "counts", "leaf").collect()}


def _prune_tops(forest: Forest) -> None:
    groups, made = _groups(forest), []
    for number, top in enumerate(_tops(forest)):
        at = {p: groups[number, int(n)] for p, n in enumerate(top.names) if top.tree.feature[p] < 0}
        for p in np.flatnonzero(top.tree.feature >= 0)[::-1]:
            (left, a), (right, b) = at[top.tree.child[p]], at[top.tree.child[p] + 1]
            alike = a and b and left.argmax() == right.argmax()
            at[p] = left + right, alike
            if alike:
                del forest.tops[number][int(top.names[p])]
                leaf = Tree(np.array([-1]), np.zeros(1, np.int16), np.zeros(1, bool), np.zeros(1, np.int32), at[p][0][None, :])
                made.append((number, int(top.names[[p]].view(np.int64)[0]), bytearray(pickle.dumps(leaf)), at[p][0].tolist(), True))
    if made:
        forest.subtrees = materialize(forest.subtrees.unionByName(forest.subtrees.sparkSession.createDataFrame(made, forest.subtrees.schema)))


def gains(forest: Forest) -> list[np.ndarray]:
    """For each tree the information gain (nats x weight) of its splits, by feature. One row a tree and feature reaches the driver."""
    out = [np.zeros(len(forest.features)) for _ in range(forest.trees)]

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, blob in zip(batch.column("tree").to_pylist(), batch.column("blob")):
                features, gain = pickle.loads(blob.as_py()).gains()
                for f in np.unique(features):
                    yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([int(f)], pa.int32()), pa.array([float(gain[features == f].sum())])], names=["tree", "feature", "gain"])
    for r in forest.subtrees.mapInArrow(below, "tree int, feature int, gain double").groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).collect():
        out[r.tree][r.feature] += r.gain
    if any(forest.tops):
        groups = _groups(forest)
        for number, top in enumerate(_tops(forest)):
            counts = {p: groups[number, int(n)][0] for p, n in enumerate(top.names) if top.tree.feature[p] < 0}
            for p in np.flatnonzero(top.tree.feature >= 0)[::-1]:
                counts[p] = counts[top.tree.child[p]] + counts[top.tree.child[p] + 1]
            features, gain = Tree(top.tree.feature, top.tree.bin, top.tree.missing_left, top.tree.child, np.array([counts[p] for p in range(len(top.names))])).gains()
            np.add.at(out[number], features, gain)
    return out


def splits_by_level(forest: Forest, levels: int) -> DataFrame:
    """(level, feature, splits) of the first ``levels`` levels of all trees."""
    tops = _tops(forest)
    level_of = [{int(n): int(v) for n, v in zip(top.names, top.level)} for top in tops]
    above = [(int(v), int(f), 1) for top in tops for v, f in zip(top.level, top.tree.feature) if f >= 0 and v < levels]

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, node, blob in zip(batch.column("tree").to_pylist(), batch.column("node").to_pylist(), batch.column("blob")):
                first = level_of[tree].get(node & (2 ** 64 - 1), levels)
                found = [(first + i, int(f)) for i, at in enumerate(pickle.loads(blob.as_py()).levels(levels - first)) for f in at] if first < levels else []
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()),
                                                  pa.array([1] * len(found), pa.int64())], names=["level", "feature", "n"])
    schema = "level int, feature int, n long"
    told = forest.subtrees.mapInArrow(below, schema).unionByName(forest.subtrees.sparkSession.createDataFrame(above, schema))
    return told.groupBy("level", "feature").agg(F.sum("n").alias("splits"))


def told(forest: Forest, asked: DataFrame, keep: str, soft: bool) -> DataFrame:
    """(h, bins, votes) for the distinct rows (h, bins) of ``asked``: trees a class, or, if ``soft``, the leaves' shares of each class added up.

    ``keep``: the votes of all trees, or of those whose bag holds the row (in) or lacks it (out)."""
    n_classes = len(forest.classes)
    rows = materialize(asked.select("h", "bins").distinct())
    n_rows = rows.count()
    # Groups are as large as those of the fit, however many rows are to be told.
    parts = max(1, math.ceil(n_rows / max(1, forest.rows)))
    run, tops, trees = _bags(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, h, bins, _, in_tree in run(batches):
            batch = (i << 32) + task
            out = [(-1, batch, batch % parts, batch, h.tobytes(), bins.tobytes())]
            for tree in range(trees):
                at, _, place = in_tree(tree, keep)
                for group, mine in _by_group(place):
                    out.append((tree, int(tops[tree].names[[group]].view(np.int64)[0]), batch % parts, batch, at[mine].astype(np.uint16).tobytes(), bins[at[mine]].tobytes()))
            yield _batch(out, ASKED)

    n_features = len(forest.features)
    def tell(asked: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and asked["tree"][0].as_py() < 0:
            out = [(b, -1, "", at, bins) for b, at, bins in zip(*(asked[c].to_pylist() for c in ("batch", "at", "bins")))]
        elif asked.num_rows and known.num_rows:
            tree: Tree = pickle.loads(known["blob"][0].as_py())
            value = tree.counts if soft else tree.counts.argmax(axis=1).astype(np.uint16)
            for number, b, at, bins in zip(*(asked[c].to_pylist() for c in ("tree", "batch", "at", "bins"))):
                place = tree.place_of(np.frombuffer(bins, np.uint8).reshape(-1, n_features), BINS)
                out.append((b, number, value.dtype.str, at, value[place].tobytes()))
        return pa.Table.from_batches([_batch(out, ANSWERED)])

    def add_up(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group[c].to_pylist() for c in ("tree", "kind", "at", "votes"))))
        h, bins = np.frombuffer(rows[0][2], np.int64), np.frombuffer(rows[0][3], np.uint8).reshape(-1, n_features)
        votes = np.zeros((len(h), n_classes), float if soft else np.int64)
        for _, kind, at, value in rows[1:]:
            at, value = np.frombuffer(at, np.uint16), np.frombuffer(value, kind)
            if soft:
                value = value.reshape(-1, n_classes)
                votes[at] += value / value.sum(axis=1, keepdims=True)
            else:
                votes[at, value] += 1
        flat = pa.array(votes.ravel())
        return pa.table({"h": h, "bins": pa.array([b.tobytes() for b in bins], pa.binary()), "votes": pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * n_classes), flat)})

    routed = _spread(rows.mapInArrow(route, "tree int, node long, part int, batch long, at binary, bins binary"), n_rows * trees, "tree", "node", "part")
    known = _spread(forest.subtrees.select("tree", "node", "blob").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), n_rows * trees, "tree", "node", "part")
    keys = ["tree", "node", "part"]
    answers = routed.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(tell, "batch long, tree int, kind string, at binary, votes binary")
    return _spread(answers, n_rows * 20, "batch").groupBy("batch").applyInArrow(add_up, f"h long, bins binary, votes array<{'double' if soft else 'bigint'}>")


def votes(forest: Forest, rows: DataFrame, key: str, out_of_bag: bool = False) -> DataFrame:
    """``rows`` with ``votes`` (trees a class, in the order of ``classes``) and ``n_votes``; ``out_of_bag``: only of trees whose bag lacks the row."""
    classes = forest.classes
    if forest.subtrees is None:
        return rows.withColumn("votes", F.array().cast("array<bigint>")).withColumn("n_votes", F.lit(0).cast("bigint"))
    kept = materialize(rows)
    counts = told(forest, kept.select(*forest.binned(key)), "out" if out_of_bag else "all", soft=False)
    counts = counts.groupBy("h").agg(F.array(*(F.sum(F.get("votes", F.lit(i))) for i in range(len(classes)))).alias("votes"))
    none = F.array(*(F.lit(0).cast("bigint") for _ in classes))
    out = kept.withColumn("_h", F.xxhash64(key)).join(counts, F.col("_h") == F.col("h"), "left").drop("_h", "h").withColumn("votes", F.coalesce("votes", none))
    return out.withColumn("n_votes", F.aggregate("votes", F.lit(0).cast("bigint"), lambda a, b: a + b))


def predicted(voted: DataFrame, classes: list[str]) -> DataFrame:
    """Adds ``prediction`` (most votes, ties to the first class; null without votes) and ``confidence`` (its share)."""
    most = F.array_max("votes")
    name = F.element_at(F.array(*map(F.lit, classes)), F.array_position("votes", most).cast("int")) if classes else F.lit(None).cast("string")
    return voted.withColumn("prediction", F.when(F.col("n_votes") > 0, name)).withColumn("confidence", F.try_divide(most, F.col("n_votes")))
