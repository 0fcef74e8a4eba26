"""Near-duplicate vectors by spherical k-means cells (operator 9).

Equal vectors of a label are one node with a count. Vectors of each length have
cells of their own. Centroids are trained by spherical k-means on a bounded
sample, and lengths with few nodes are one cell; every node is then assigned to its
nearest cells, the first as its own and the others as a visitor, so that a
pair is compared if either has the other's own cell among its nearest. Within a
cell and label, blocks of nodes are multiplied with blocks of nodes in double
precision, and a pair at the threshold or above is a link. A task gives each
node's number of links and a spanning set of its links, never all pairs.

Vectors that are null, empty or zero, or hold a null or non-finite component,
and vectors without a label, link with nothing, and vectors of different
lengths not with each other: their component is themselves. Rows that share a vec_id are one
vector in components, and each counts the other as a link if they link.
Rows without a vec_id are returned without component and are kept. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nutrilake.llm.components import components
from nutrilake.session import materialize

COSINE = 0.98
#: Vectors that the centroids are trained on, at most; their rounds; cells that a vector is assigned to.
SAMPLE, ROUNDS, NEAREST = 20_000, 10, 4
#: Nodes of one label and cell that are compared with as many others in one task.
BLOCK = 1024
#: Products of vectors with centroids that are held at once.
PRODUCTS = 4_000_000


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Unit centroids of the unit rows of ``x``; a cell left empty takes the row that fits its own worst."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    cell, fit = np.zeros(len(x), np.int64), np.zeros(len(x))
    for _ in range(rounds):
        for lo in range(0, len(x), step := max(1, PRODUCTS // k)):
            near = x[lo: lo + step] @ centres.T
            cell[lo: lo + step] = near.argmax(axis=1)
            fit[lo: lo + step] = near.max(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        size = np.linalg.norm(total, axis=1)
        empty = np.flatnonzero(size < 1e-12)
        worst = np.argsort(fit)[: len(empty)]
        total[empty], size[empty] = x[worst], 1.0
        centres = total / size[:, None]
    return centres


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and ``v`` (doubles) of the rows that can link."""
    def broken(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    known = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    return known.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")) \
        .where(~F.exists("v", broken) & F.exists("v", lambda x: F.coalesce(x, F.lit(0.0)) != 0.0))


def centroids(nodes: DataFrame, sample: int = SAMPLE, least: int = BLOCK) -> dict[int, np.ndarray]:
    """By vector length, about sqrt(n) cells from at most ``sample`` nodes in all, by hash order; none but one cell for up to ``least`` nodes."""
    # One row a length.
    sizes = {r["d"]: r["count"] for r in nodes.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()}
    out = {}
    for d, n in sizes.items():
        if n <= least:
            out[d] = np.zeros((0, d))
            continue
        rows = nodes.where(F.size("v") == d).select("node", "v").orderBy(F.xxhash64("node"), "node") \
            .limit(-(-sample * n // sum(sizes.values()))).select("v").toArrow()
        x = np.asarray(rows["v"].combine_chunks().flatten(), np.float64).reshape(-1, d)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out[d] = spherical_kmeans(x, min(len(x), max(1, math.isqrt(n))))
    return out


def assigned(nodes: DataFrame, centres: dict[int, np.ndarray], nearest: int = NEAREST) -> DataFrame:
    """``node``, ``label``, ``copies``, ``unit`` (bytes of doubles) and ``cells``, its nearest cells from the nearest on.

    Cells are numbered through all lengths, so that no cell has vectors of two."""
    first = dict(zip(centres, np.cumsum([0, *(max(1, len(c)) for c in centres.values())]).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.diff(np.asarray(batch.column(3).offsets))
            for d in np.unique(length).tolist():
                rows = np.flatnonzero(length == d)
                for lo in range(0, len(rows), step := min(2000, max(1, PRODUCTS // max(1, len(centres[d]))))):
                    part = batch.take(pa.array(rows[lo: lo + step]))
                    x = np.asarray(part.column(3).flatten()).reshape(part.num_rows, d)
                    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    k = len(centres[d])
                    near = np.argsort(-(x @ centres[d].T), axis=1, kind="stable")[:, : min(nearest, k)] if k else np.zeros((len(x), 1), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:3], pa.array([r.tobytes() for r in x], pa.binary()),
                         pa.array((near + first[d]).tolist(), pa.list_(pa.int32()))], names=["node", "label", "copies", "unit", "cells"])

    given = nodes.select("node", F.col("label").cast("string").alias("label"), "copies", "v")
    return given.mapInArrow(run, "node long, label string, copies long, unit binary, cells array<int>")


def linked_blocks(cells: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Rows ``node``, ``other``, ``links``: partial numbers of linked vectors (``other`` null), and links that span them (``links`` 0)."""
    placed = cells.select("node", "label", "copies", "unit", "cells", F.posexplode("cells").alias("rank", "cell"))
    sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count_if(F.col("rank") == 0) / block).cast("int").alias("own"),
                                                F.ceil(F.count("*") / block).cast("int").alias("all")).where("own > 0")
    rows = placed.join(sizes, ["label", "cell"])
    spread = F.xxhash64("node", F.lit(3))
    x = rows.where("rank = 0").withColumn("x", F.pmod(spread, F.col("own")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("all") - 1)))
    y = rows.withColumn("y", F.pmod(spread, F.col("all")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("own") - 1)))
    fields = ["label", "cell", "x", "y", "side", "node", "copies", "unit", "cells"]
    dealt = x.withColumn("side", F.lit(0)).select(*fields).unionByName(y.withColumn("side", F.lit(1)).select(*fields)) \
        .repartition("label", "cell", "x", "y").sortWithinPartitions("label", "cell", "x", "y", "side", "node")

    def compare(cell: int, group: list[tuple]) -> tuple[list, list, list]:
        side, node, copies, unit, near = zip(*group)
        side, node, copies = np.array(side), np.array(node), np.array(copies)
        vectors = np.frombuffer(b"".join(unit), np.float64).reshape(len(group), -1)
        own_cell = np.array([c[0] for c in near])
        ours, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(ours) or not len(theirs):
            return [], [], []
        hit = vectors[ours] @ vectors[theirs].T >= cosine
        hit &= node[ours][:, None] != node[theirs][None]
        # A visitor's pair is also met in the visitor's own cell if that is among this node's nearest: count it in the lower cell.
        for c in np.unique(own_cell[theirs]):
            if c < cell:
                also = np.array([c in near[i] for i in ours])
                hit[np.ix_(also, own_cell[theirs] == c)] = False
        i, j = np.nonzero(hit)
        guest = own_cell[theirs][j] != cell
        nodes, links = [], []
        for at, count in ((node[ours][i], copies[theirs][j]), (node[theirs][j][guest], copies[ours][i][guest])):
            if len(at):
                who, where = np.unique(at, return_inverse=True)
                nodes += who.tolist()
                links += np.bincount(where, count, len(who)).astype(np.int64).tolist()
        # Spanning links: the smallest root of each side's nodes, passed on until nothing changes.
        others: list = [None] * len(nodes)
        if len(i):
            names = np.unique(np.concatenate([node[ours][i], node[theirs][j]]))
            a, b = np.searchsorted(names, node[ours][i]), np.searchsorted(names, node[theirs][j])
            root = np.arange(len(names))
            while True:
                low = np.minimum(root[a], root[b])
                new = root.copy()
                np.minimum.at(new, a, low)
                np.minimum.at(new, b, low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            far = np.flatnonzero(root != np.arange(len(names)))
            nodes += names[far].tolist()
            others += names[root[far]].tolist()
            links += [0] * len(far)
        return nodes, others, links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, group = None, []

        def done() -> pa.RecordBatch:
            nodes, others, links = compare(here[1], group) if group else ([], [], [])
            return pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "other": pa.array(others, pa.int64()),
                                               "links": pa.array(links, pa.int64())})

        for batch in batches:
            for label, cell, x, y, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if here != (label, cell, x, y):
                    if group:
                        yield done()
                    here, group = (label, cell, x, y), []
                group.append(tuple(rest))
        yield done()

    return dealt.mapInArrow(run, "node long, other long, links long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row."""
    given = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label")
    usable = usable_vectors(given)
    # Equal vectors of a label are one node, named by a number that no other node has.
    grouped = usable.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    nodes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()))
    centres = centroids(nodes)
    if not centres:
        found = None
    else:
        found = materialize(linked_blocks(materialize(assigned(nodes, centres)), cosine))
    named = nodes.select("node", "label", "v", "first", "copies")
    if found is not None:
        counts = found.where(F.col("other").isNull()).groupBy("node").agg(F.sum("links").alias("links"))
        first = nodes.select(F.col("node").alias("n"), F.col("first").alias("f"))
        edges = found.where(F.col("other").isNotNull()).join(first, F.col("node") == F.col("n")).select("other", F.col("f").alias("a")) \
            .join(first, F.col("other") == F.col("n")).select("a", F.col("f").alias("b"))
        named = named.join(counts, "node", "left")
    else:
        edges = nodes.select(F.col("first").alias("a"), F.col("first").alias("b")).where("false")
        named = named.withColumn("links", F.lit(0).cast("bigint"))
    mine = usable.join(named.withColumnsRenamed({"label": "l", "v": "w"}), (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))) \
        .select("vec_id", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    mine = materialize(mine)
    roots = components(edges.unionByName(mine.select(F.col("vec_id").alias("a"), F.col("first").alias("b"))))
    out = mine.join(roots, F.col("vec_id") == F.col("node"), "left").select("vec_id", "n_links", F.coalesce("root", "vec_id").alias("component_id"))
    # The other rows, as many of each vec_id as there are.
    rows = given.groupBy("vec_id").agg(F.count("*").alias("n"))
    done = mine.groupBy("vec_id").agg(F.count("*").alias("m"))
    rest = rows.join(done, rows["vec_id"].eqNullSafe(done["vec_id"]), "left").select(rows["vec_id"], (F.col("n") - F.coalesce("m", F.lit(0))).cast("int").alias("left")) \
        .where("left > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("left")))) \
        .join(roots, F.col("vec_id") == F.col("node"), "left") \
        .select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
