"""Sharding by a hierarchical weighted hash tree (operator 11), in DataFrame operations only.

Shards are the leaves of a tree (regions, racks, shards). A document goes
down level by level: each child of the node that it has reached makes a draw,
-ln(hash) / weight, with the hash of the document's id and the child's name,
and the smallest draw wins, so that a child gets documents in proportion to
its weight, the sum of the weights of its leaves. Draws of other children do
not change when a child's weight does: documents move only out of subtrees that became lighter
and into subtrees that became heavier.

A leaf that is added later (``grown``) opens a new layer: at the top, the
weight that its region gained is a child of its own, and who follows it goes
down only among the leaves of that layer. So a document either stays in its
shard or goes to the new one, though this one lies in a rack that was there
before.

Slots number the documents of a shard in the order of the id's hash without
putting a shard in one task: rows are dealt into ranges of that order, ranges
are counted, and each range starts where those before it end. A salt in the order lets
ranges cut through rows that are equal in all other respects.

Null and empty texts have no bytes. Rows without a doc_id, and rows that
share one, are in one shard, each with a slot of its own. Extra columns are
ignored by ``sharded`` and kept by ``placed``; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nutrilake.llm.mixing import running_start
from nutrilake.session import materialize


@dataclass(frozen=True)
class Leaf:
    """A shard: the nodes above it from the top down, its weight, and the layer that it was added in."""

    shard: int
    path: tuple[str, ...]
    weight: float = 1.0
    layer: int = 0


def even_tree(regions: int = 2, racks: int = 3, shards: int = 4) -> list[Leaf]:
    """Shards 0, 1, ... of equal weight in ``regions`` regions of ``racks`` racks of ``shards`` shards each."""
    return [Leaf((r * racks + k) * shards + s, (f"region {r}", f"rack {k}")) for r in range(regions) for k in range(racks) for s in range(shards)]


def grown(tree: list[Leaf], path: tuple[str, ...], shard: int, weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard under ``path``; documents move only into it."""
    return [*tree, Leaf(shard, path, weight, 1 + max(leaf.layer for leaf in tree))]


def nodes_of(tree: list[Leaf]) -> list[list[tuple[str, float, int]]]:
    """Children (name, weight, next) of each inner node, the root first; a ``next`` below 0 is the shard -1 - next."""
    nodes: list[dict[str, list]] = [{}]
    if len({leaf.shard for leaf in tree}) < len(tree) or len({len(leaf.path) for leaf in tree}) != 1 or any(leaf.weight < 0 for leaf in tree):
        raise ValueError("shards must be different, at one depth, and weights not negative")
    for leaf in (leaf for leaf in tree if leaf.weight > 0):
        at, name = 0, str(leaf.layer)
        for step in leaf.path:
            name = f"{name}/{step}"
            child = nodes[at].setdefault(name, [0.0, len(nodes)])
            if child[1] == len(nodes):
                nodes.append({})
            child[0] += leaf.weight
            at = child[1]
        nodes[at][f"{name}/{leaf.shard}"] = [leaf.weight, -1 - leaf.shard]
    return [[(name, float(weight), to) for name, (weight, to) in children.items()] for children in nodes]


def draw(key: Column, name: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from the first 52 bits of the hash of key and name."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, name)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a document by its key (a string)."""
    nodes = nodes_of(tree)
    children = F.array(*(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.lit(to).alias("to")) for n, w, to in c)) for c in nodes))
    at = F.lit(0)
    for _ in range(len(tree[0].path) + 1):
        at = F.array_min(F.transform(F.element_at(children, at + 1),
                                     lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c["to"].alias("to"))))["to"]
    return -1 - at


def id_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def placed(docs: DataFrame, tree: list[Leaf], doc_id: str = "doc_id", name: str = "shard") -> DataFrame:
    """The rows of ``docs`` with their shard, without a shuffle; a column that is already called so is replaced."""
    return docs.withColumn(name, shard_of(id_key(F.col(doc_id)), tree))


def with_slots(rows: DataFrame, group: str, order: list[str], least_parts: int = 64) -> DataFrame:
    """Adds ``slot``: 0, 1, ... within each ``group`` by ``order``; the number of groups is bounded by the caller."""
    parts = max(least_parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.withColumn("_salt", F.rand(7))
    dealt = materialize(salted.repartitionByRange(parts, group, *order, "_salt").withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part", group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range, and one more for each group that starts within a range.
    start = counts.select("_part", group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order, "_salt")) - 1
    return dealt.join(F.broadcast(start), ["_part", group]).withColumn("slot", own + F.col("_start")).drop("_part", "_start", "_salt")


def sharded(docs: DataFrame, tree: list[Leaf], bigger: list[Leaf] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``size`` (bytes and 8), ``text_crc32``, ``shard``, ``slot``, and its shard in the tree ``bigger``."""
    octets = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(octets) + 8).cast("bigint").alias("size"), F.crc32(octets).alias("text_crc32"))
    key = id_key(F.col("doc_id"))
    rows = rows.withColumn("shard", shard_of(key, tree)) \
        .withColumn("grown_shard", shard_of(key, bigger) if bigger else F.lit(None).cast("int")).withColumn("_key", F.md5(key))
    return with_slots(rows, "shard", ["_key", "doc_id", "text_crc32"]).drop("_key")


def write_shards(docs: DataFrame, tree: list[Leaf], path: str, doc_id: str = "doc_id") -> None:
    """Writes the rows as one Parquet folder a shard, each file a range of the order of the id's hash."""
    rows = placed(docs, tree, doc_id).withColumn("_key", F.md5(id_key(F.col(doc_id)))).withColumn("_salt", F.rand(7))
    parts = max(len(tree), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(parts, "shard", "_key", "_salt").sortWithinPartitions("shard", "_key", "_salt").drop("_key", "_salt") \
        .write.partitionBy("shard").parquet(path)


#: The production tree, and the same with shard 24 in the last rack.
TREE = even_tree()
BIGGER = grown(TREE, ("region 1", "rack 2"), 24)

#: What the production query gives, as DuckDB SQL; the checksum is computed byte by byte with the table of its polynomial.
ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS v, 0 AS k FROM range(256) r(n)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE k = 8),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT id, doc_id, length(h) // 2 AS n, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d),
c AS (SELECT id, doc_id, CAST(n + 8 AS BIGINT) AS size,
             xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) AS text_crc32 FROM b, crc),
ids AS (SELECT DISTINCT id FROM d),
r AS (SELECT id, r, -ln((CAST('0x' || substr(md5(id || ':0/region ' || r), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / 12 AS draw FROM ids, range(2) t(r)),
p1 AS (SELECT id, arg_min(r, draw) AS r,
              min(draw) > -ln((CAST('0x' || substr(md5(id || ':1/region 1'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS moves FROM r GROUP BY id),
k AS (SELECT id, r, moves, k, -ln((CAST('0x' || substr(md5(id || ':0/region ' || r || '/rack ' || k), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / 4 AS draw
      FROM p1, range(3) t(k)),
p2 AS (SELECT id, r, moves, arg_min(k, draw) AS k FROM k GROUP BY id, r, moves),
s AS (SELECT id, moves, (r * 3 + k) * 4 + s AS s,
             -ln((CAST('0x' || substr(md5(id || ':0/region ' || r || '/rack ' || k || '/' || ((r * 3 + k) * 4 + s)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS draw
      FROM p2, range(4) t(s)),
p3 AS (SELECT id, moves, CAST(arg_min(s, draw) AS INTEGER) AS shard FROM s GROUP BY id, moves)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(c.id), doc_id NULLS FIRST, text_crc32) - 1 AS slot,
       CASE WHEN moves THEN 24 ELSE shard END AS grown_shard
FROM c JOIN p3 ON c.id = p3.id
"""
