"""Near-duplicate documents by DartMinHash signatures (operator 1).

A document is the weighted set of its runs of five words, weighted by how
often each occurs; a shorter text with words is one run. Darts are thrown by
hash into the plane of an element's weight and a rank: every unit cell of
that plane holds a Poisson number of darts at hashed places, the same ones in
every document. A document sees the darts below its elements' weights and
below a rank that gives about k ln k + 2k of them; each dart belongs to one of
k coordinates, and the earliest dart of a coordinate is the signature's
entry. Two documents agree in a coordinate with the probability of their
weighted Jaccard similarity. Where a coordinate got no dart, the document
looks twice as far.

Signatures are joined by bands. Texts with equal words are one node from the
start. Within a bucket every node is compared with the bucket's centre, by
exact similarity; nodes of a bucket that are then still in other components
are compared with one another unless their similarities to the centre already
rule a link out (1 - similarity is a metric). The centre is the member that
shares most buckets with others. No bucket is cut.

Texts without words are linked with nothing. Rows that share a doc_id are one
document: their texts' links are united. Rows without a doc_id are compared
with nothing, have no class and are kept. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nutrilake.llm.components import components
from nutrilake.llm.textbytes import U64, Texts, mix64, ngram_hashes, texts_of, unit
from nutrilake.session import materialize, release

WORDS, SIMILARITY = 5, 0.8
#: Bands and rows: a pair at the similarity is missed by all bands with probability (1 - 0.8^7)^40 < 1e-4.
BANDS, ROWS = 40, 7
#: Members of a star that one task compares with its centre; members of a bucket that one task compares with as many others.
STAR_BLOCK, BUCKET_BLOCK = 256, 512
#: Coordinates of the longer sketches that members apart from a centre get, and the standard errors below the
#: similarity at which their estimate still calls for the exact one.
SKETCH, SLACK = 1024, 3.8
_CDF = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def weighted_elements(texts: Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of every distinct run of words; ordered by document and hash."""
    start, end, doc = texts.words()
    word = texts.hash_of(start, end)
    runs, first = ngram_hashes(word, doc, words)
    owner = doc[first]
    n_words = np.bincount(doc, minlength=texts.n)
    # A text with fewer words is one run of what it has.
    for n in range(1, words):
        short = np.flatnonzero(n_words == n)
        if len(short):
            mine = np.isin(doc, short)
            more, at = ngram_hashes(word[mine], doc[mine], n)
            runs, owner = np.concatenate([runs, mix64(more + U64(n))]), np.concatenate([owner, doc[mine][at]])
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], runs[at], np.diff(np.concatenate([at, [len(runs)]]))


#: Cells whose darts are thrown at once.
CELLS = 1 << 20


def _darts(d: np.ndarray, e: np.ndarray, w: np.ndarray, high: np.ndarray, deep: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Slot (row and coordinate), place in time and name of every dart that falls into the regions of the given elements."""
    cells = high * deep
    which = np.repeat(np.arange(len(d)), cells)
    cell = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
    up, rank = cell // deep[which], cell % deep[which]
    with np.errstate(over="ignore"):
        seed = mix64(e[which] ^ mix64(up.astype(U64) * U64(0x9E3779B97F4A7C15) + rank.astype(U64)))
    darts = np.searchsorted(_CDF, unit(seed))
    at = np.repeat(np.arange(len(which)), darts)
    with np.errstate(over="ignore"):
        dart = mix64(seed[at] + (np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)).astype(U64) + U64(1))
    owner = d[which[at]]
    place = rank[at] + unit(mix64(dart ^ U64(0xA5A5A5A5A5A5A5A5)))
    seen = place < limit[owner]
    partial = w[which[at]] < up[at] + 1  # only a cell that the weight ends in
    if partial.any():
        seen &= ~partial | (up[at] + unit(mix64(dart ^ U64(0x5A5A5A5A5A5A5A5A))) < w[which[at]])
    dart, place = dart[seen], place[seen]
    return owner[seen] * k + (dart % U64(k)).astype(np.int64), place, dart


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n x k) of weighted sets; rows of empty sets are 0. Weights may be any numbers above 0."""
    out = np.zeros((n, k), U64)
    total = np.bincount(doc, weight, n)
    reach = np.divide(k * math.log(max(k, 2)) + 2 * k, total, out=np.zeros(n), where=total > 0)
    open_rows = np.flatnonzero(total > 0)
    while len(open_rows):
        number = np.full(n, -1)
        number[open_rows] = np.arange(len(open_rows))
        mine = number[doc] >= 0
        d, e, w = number[doc[mine]], element[mine], weight[mine]
        limit = reach[open_rows]
        # Unit cells of (weight, rank) that the region of each element touches, a block of cells at a time.
        high, deep = np.ceil(w).astype(np.int64), np.ceil(limit).astype(np.int64)[d]
        upto = np.cumsum(high * deep)
        best, found = np.full(len(open_rows) * k, np.inf), np.zeros(len(open_rows) * k, U64)
        lo = 0
        while lo < len(d):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CELLS, side="right")))
            slot, place, dart = _darts(d[lo:hi], e[lo:hi], w[lo:hi], high[lo:hi], deep[lo:hi], limit, k)
            np.minimum.at(best, slot, place)
            first = place == best[slot]
            found[slot[first]] = dart[first]
            lo = hi
        full = np.isfinite(best.reshape(-1, k)).all(axis=1)
        out[open_rows[full]] = found.reshape(-1, k)[full]
        open_rows = open_rows[~full]
        reach[open_rows] *= 2
    return out


def sequence_hashes(texts: Texts) -> np.ndarray:
    """128 bits of each document's word sequence, as (n x 2)."""
    start, end, doc = texts.words()
    word = texts.hash_of(start, end)
    out = np.zeros((texts.n, 2), U64)
    if len(word):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        size = np.diff(np.concatenate([first, [len(doc)]]))
        place = (np.arange(len(doc)) - np.repeat(first, size)).astype(U64)
        for j in range(2):
            with np.errstate(over="ignore"):
                terms = mix64(word ^ mix64(place + U64(j << 60)))
                out[doc[first], j] = mix64(np.add.reduceat(terms, first) + size.astype(U64))
    return out


def signature_table(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """``doc_id``, ``words_hash`` (null without words), ``bands`` (array of long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(1), 500_000):
                doc, element, weight = weighted_elements(texts, words)
                sig = dart_signatures(doc, element, weight.astype(float), texts.n, bands * rows)
                sig = sig.reshape(texts.n, bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=U64), (texts.n, bands)).copy()
                with np.errstate(over="ignore"):
                    for j in range(rows):
                        key = mix64(key * U64(0xD6E8FEB86659FD93) + sig[:, :, j])
                has = np.bincount(doc, minlength=texts.n) > 0
                whole = [h.tobytes() if w else None for h, w in zip(sequence_hashes(texts), has)]
                ends = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[has].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.lo, texts.n), pa.array(whole, pa.binary()), lists],
                                                 names=["doc_id", "words_hash", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, words_hash binary, bands array<long>")


def sketch_table(docs: DataFrame, k: int, words: int) -> DataFrame:
    """``doc_id`` and ``sketch``: a byte of each of ``k`` coordinates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(1), 200_000):
                doc, element, weight = weighted_elements(texts, words)
                sig = dart_signatures(doc, element, weight.astype(float), texts.n, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.lo, texts.n),
                                                  pa.array([x.tobytes() for x in (sig >> U64(56)).astype(np.uint8)], pa.binary())],
                                                 names=["doc_id", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sketch binary")


def similarities(pairs: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``a``, ``b`` and ``j``, the exact weighted Jaccard similarity of the documents of each pair.

    Pairs are stars around ``a``: each text travels once for each of its pairs as ``b``, and a centre's text once for
    each block of STAR_BLOCK members, so that a centre with many members is split over tasks.
    """
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_BLOCK).cast("int").alias("blocks"))
    members = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    centres = blocks.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = members.unionByName(centres).join(docs.select(F.col("doc_id").alias("b"), "text"), "b") \
        .select("a", "block", (F.col("a") != F.col("b")).alias("member"), "b", "text")
    grouped = rows.repartition("a", "block").sortWithinPartitions("a", "block", "member", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, centre = None, []
        for batch in batches:
            a, block, member, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            out_a, out_b, out_j = [], [], []
            for texts in texts_of(batch.column(4), 500_000):
                doc, element, weight = weighted_elements(texts, words)
                cut = np.searchsorted(doc, np.arange(texts.n + 1))
                for i in range(texts.n):
                    r = texts.lo + i
                    e, w = element[cut[i]: cut[i + 1]], weight[cut[i]: cut[i + 1]]
                    if not member[r]:
                        if here != (a[r], block[r]):
                            here, centre = (a[r], block[r]), []
                        centre.append((e.copy(), w.copy()))
                        continue
                    best = 0.0
                    for ce, cw in centre if here == (a[r], block[r]) else []:
                        at = np.minimum(np.searchsorted(ce, e), len(ce) - 1) if len(ce) else np.zeros(0, np.int64)
                        both = np.minimum(w, cw[at])[ce[at] == e].sum() if len(ce) and len(e) else 0
                        best = max(best, both / max(1, w.sum() + cw.sum() - both))
                    out_a.append(a[r])
                    out_b.append(b[r])
                    out_j.append(best)
            yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()),
                                              "j": pa.array(out_j, pa.float64())})

    return grouped.mapInArrow(run, "a long, b long, j double").groupBy("a", "b").agg(F.max("j").alias("j"))


def likely_pairs(known: DataFrame, sketches: DataFrame, similarity: float, k: int) -> DataFrame:
    """``a`` < ``b``: pairs of a bucket in different components, one of them apart from the centre, that may reach the similarity.

    Neither their similarities ``j`` to the centre nor the agreement of their sketches rules such a pair out. A
    bucket's members are dealt in blocks, and a task compares a block of those apart with a block of all.
    """
    bound = similarity - SLACK * math.sqrt(similarity * (1 - similarity) / k)
    apart = F.col("a_root") != F.col("b_root")
    blocks = known.groupBy("bucket").agg(F.ceil(F.count_if(apart) / BUCKET_BLOCK).cast("int").alias("xs"),
                                         F.ceil(F.count("*") / BUCKET_BLOCK).cast("int").alias("ys"))
    # Several texts of a doc_id are a row each.
    rows = known.join(blocks, "bucket").join(sketches.withColumnRenamed("doc_id", "b"), "b")
    spread = F.xxhash64("b", F.lit(1))
    one = rows.where(apart).withColumn("x", F.pmod(spread, F.col("xs")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("ys") - 1)))
    all_ = rows.withColumn("y", F.pmod(spread, F.col("ys")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)))
    fields = ["bucket", "x", "y", "side", "b", "j", "b_root", "sketch"]
    dealt = one.withColumn("side", F.lit(0)).select(*fields).unionByName(all_.withColumn("side", F.lit(1)).select(*fields)) \
        .repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "side", "b")

    def compare(group: list[tuple]) -> tuple[list[int], list[int]]:
        side, node, j, root, sketch = zip(*group)
        side, node, j, root = (np.array(v) for v in (side, node, j, root))
        sketch = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(group), k)
        ours, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = [], []
        for i in ours:
            open_ = theirs[(root[theirs] != root[i]) & (np.abs(j[theirs] - j[i]) <= 1 - similarity + 1e-9)]
            near = open_[(sketch[open_] == sketch[i]).sum(axis=1) >= bound * k]
            a += np.minimum(node[near], node[i]).tolist()
            b += np.maximum(node[near], node[i]).tolist()
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, group = None, []

        def done() -> pa.RecordBatch:
            a, b = compare(group) if group else ([], [])
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            for bucket, x, y, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if here != (bucket, x, y):
                    if group:
                        yield done()
                    here, group = (bucket, x, y), []
                group.append(tuple(rest))
        yield done()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``class_id`` (smallest doc_id of its class) and ``kept`` (the document is its class's first) for every row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    named = docs.where(F.col("doc_id").isNotNull())
    signed = signature_table(named, bands, rows, words)
    signed = materialize(signed)
    nodes = signed.where(F.col("words_hash").isNotNull()).groupBy("words_hash").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    nodes = materialize(nodes)

    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(placed.join(sizes, "bucket"))
    # A bucket's centre is the member that meets most others over all its buckets: an original before its copies.
    centre = F.struct(F.col("met"), (-F.col("node")).alias("order"))
    met = shared.groupBy("node").agg(F.sum("n").alias("met"))
    members = shared.join(met, "node")
    centres = members.groupBy("bucket").agg((-F.max(centre)["order"]).alias("a"))
    members = materialize(members.join(centres, "bucket").select("bucket", "a", F.col("node").alias("b"), "n"))
    stars = materialize(similarities(members.where("a != b").select("a", "b").distinct(), named, words))
    links = stars.where(F.col("j") >= similarity).select("a", "b")
    release(docs.sparkSession)

    # Buckets that still hold several components: their members outside the smallest node's component.
    roots = components(links)
    release(docs.sparkSession)
    known = members.where("n > 2").join(stars, ["a", "b"], "left").withColumn("j", F.coalesce("j", F.lit(1.0)))
    for side in ("a", "b"):
        known = known.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side, "left") \
            .withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))
    known = materialize(known.where("a != b").select("bucket", "b", "j", "a_root", "b_root"))
    unsettled = known.groupBy("bucket").agg(F.count_if(F.col("a_root") != F.col("b_root")).alias("x"), F.count("*").alias("n")) \
        .where("x > 0 and n > 1").select("bucket")
    known = materialize(known.join(unsettled, "bucket", "left_semi"))
    release(docs.sparkSession)
    near = materialize(named.join(known.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    further = materialize(likely_pairs(known, sketch_table(near, SKETCH, words), similarity, SKETCH))
    release(docs.sparkSession)
    more = similarities(further, near, words).where(F.col("j") >= similarity).select("a", "b")

    # Rows of one doc_id with different texts are one document.
    same = signed.where(F.col("words_hash").isNotNull()).groupBy("doc_id") \
        .agg(F.min("words_hash").alias("lo"), F.max("words_hash").alias("hi")).where("lo != hi").select("doc_id")
    united = signed.join(same, "doc_id", "left_semi").join(nodes.select("words_hash", "node"), "words_hash") \
        .select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    classes = components(links.unionByName(more).unionByName(united))
    release(docs.sparkSession)

    owner = signed.select("doc_id", "words_hash").join(nodes.select("words_hash", "node"), "words_hash", "left") \
        .withColumn("node", F.coalesce("node", "doc_id"))
    found = owner.join(classes, "node", "left").select("doc_id", F.coalesce("root", "node").alias("class_id"))
    nameless = docs.where(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("bigint").alias("class_id"))
    return found.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
