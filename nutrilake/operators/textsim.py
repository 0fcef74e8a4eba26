"""TF-IDF text similarity.

The fit (A10) is plain grouping: tokens -> (doc, term) counts -> document
frequencies -> weights ``tf * (ln((1+n)/(1+df)) + 1)`` normalised per doc.

Top-k similar documents (J9 / J10) are exact without comparing every pair:

1. Documents with equal vectors are one *class*, targets with equal needs one
   *unit*; of a class only the documents stay that can be among the first k.
   A closed vocabulary has a bounded number of classes, however long the table.
2. A unit's terms are taken from the rarest up. Classes sharing one of them
   are found through postings (an equi-join on the term) and scored exactly; a
   class that shares none of them scores at most the sum of w_target * max_w
   over the terms left. When the k-th similarity beats that sum, the unit is
   done; else the k-th similarity tells which further terms it needs.
3. Units whose postings would be too long are compared with the classes in
   bounded blocks, as one if they differ only in terms whose postings have been looked at (products over 1024 terms at a time, numpy in
   ``cogroup().applyInPandas``), which only emit each unit's best. Blocks
   hold classes of like heaviest terms, and a block whose largest weights cannot reach a
   unit's k-th similarity is not looked at.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nutrilake.session import materialize, release

TOKEN_PATTERN = r"(?U)\b\w\w+\b"
SIM_DIGITS = 9


def load_stop_words() -> list[str]:
    path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "resources", "stopwords_en.txt")
    with open(path, encoding="utf-8") as fh:
        return [w.strip() for w in fh if w.strip() and not w.startswith("#")]


def similarity_text(name: Column, categories: Column, ingredients: Column, brands: Column) -> Column:
    """the four fields joined by a space, a missing field as ""."""
    return F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in
                              (name, categories, ingredients, brands)])


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-cased tokens of two or more word characters, stop words removed."""
    toks = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)
    if stop_words:
        toks = F.filter(toks, lambda t: ~t.isin(*stop_words))  # a hash set in the plan
    return toks


#: Terms whose document frequency is broadcast, at most.
FREQUENT = 100_000
#: Documents whose terms a task counts, at most about.
TASK_DOCS = 16384


def tfidf_fit(docs: DataFrame, key: str, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """A10: (key, term, w) with L2-normalised smooth-idf weights.

    A document without tokens has no rows (a zero vector). The tokens are
    shuffled once, by document; only terms that are not among the frequent
    ones travel by term to meet their document frequency."""
    n_docs = docs.count()
    n, parts = F.lit(n_docs), max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_docs // TASK_DOCS))
    read = docs.select(F.col(key).alias("doc"), tokens(F.col(text), stop_words).alias("toks")).repartition(parts, "doc")

    def counted(rows: DataFrame) -> DataFrame:
        return rows.select("doc", F.explode("toks").alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    dfreq = materialize(counted(read).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    often = max(2, -(-(dfreq.agg(F.sum("df")).first()[0] or 0) // FREQUENT))
    frequent = F.broadcast(dfreq.where(F.col("df") >= often))  # FREQUENT terms at most, by the choice of ``often``
    read = read.where(F.col("doc").isNotNull())
    tf = counted(read)
    w = F.col("tf") * (F.log((F.lit(1) + n) / (F.lit(1) + F.col("df"))) + F.lit(1.0))
    entries = F.collect_list(F.struct("term", "df", w.alias("w")))
    common = tf.join(frequent, "term").groupBy("doc").agg(entries.alias("common"))
    scarce = tf.join(frequent, "term", "left_anti").join(dfreq.where(F.col("df") < often), "term") \
        .repartition(parts, "doc").groupBy("doc").agg(entries.alias("scarce"))
    none = F.array().cast("array<struct<term:string,df:bigint,w:double>>")
    held = read.select("doc").distinct().join(common, "doc", "left").join(scarce, "doc", "left") \
        .select("doc", F.array_sort(F.concat(F.coalesce("common", none), F.coalesce("scarce", none))).alias("held"))
    norm = F.sqrt(F.aggregate("held", F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))
    return (held.select("doc", "held", norm.alias("norm")).select("doc", "norm", F.inline("held"))
            .select(F.col("doc").alias(key), "term", "df", (F.col("w") / F.col("norm")).alias("w")))


def _flat(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every entry of the rows' ``terms`` and ``ws``."""
    rows = np.repeat(np.arange(len(df)), df["terms"].str.len().to_numpy(dtype=np.int64))
    empty = [np.zeros(0, object)]
    return (rows, np.concatenate([*empty, *(np.asarray(t, dtype=object) for t in df["terms"])]),
            np.concatenate([np.zeros(0), *(np.asarray(w, dtype=np.float64) for w in df["ws"])]))


def _products(q: pd.DataFrame, r_flat: tuple[np.ndarray, np.ndarray, np.ndarray], n_r: int, width: int = 1024) -> np.ndarray:
    """Inner products of all rows of q and the ``n_r`` rows of r, ``width`` terms at a time."""
    q_row, q_term, q_w = _flat(q)
    r_row, r_term, r_w = r_flat
    q_col, vocab = pd.factorize(q_term)
    r_col = pd.Index(vocab).get_indexer(r_term)
    sims = np.zeros((len(q), n_r))
    for lo in range(0, len(vocab), width):
        qm, rm = np.zeros((len(q), width)), np.zeros((n_r, width))
        for m, row, col, w in ((qm, q_row, q_col, q_w), (rm, r_row, r_col, r_w)):
            here = (col >= lo) & (col < lo + width)
            m[row[here], col[here] - lo] = w[here]
        sims += qm @ rm.T
    return sims


UNIT = ["ucls", "slot", "need"]
HITS = "ucls long, slot int, need int, cls long, sim double, b_score double, b_doc long"


def _block_kernel(query_block: int):
    """The best ``need`` classes of a block for every unit, in the order of their best eligible document;
    ``query_block`` units are compared at once."""
    def fn(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c.split()[0]: pd.Series(dtype={"long": "int64", "int": "int32"}.get(c.split()[1], "float64"))
                              for c in HITS.split(", ")})
        if q.empty or r.empty:
            return empty
        r_flat = _flat(r)
        cls = r["cls"].to_numpy(dtype=np.int64)
        is_open = np.stack(r["is_open"].to_numpy())
        score = np.stack([np.asarray(x, dtype=np.float64) for x in r["b_score"]])
        doc = np.stack([np.asarray(x, dtype=np.int64) for x in r["b_doc"]])
        out = [empty]
        for lo in range(0, len(q), query_block):
            some = q.iloc[lo: lo + query_block]
            whole = -np.rint(_products(some, r_flat, len(r)) * 10.0 ** SIM_DIGITS).astype(np.int64)
            for (slot, need), rows in some.groupby(["slot", "need"], sort=False).indices.items():
                able = np.nonzero(is_open[:, slot])[0]
                kk = min(int(need), len(able))
                if not kk:
                    continue
                # one integer key a pair: rounded similarity first, then score (missing last), then id
                tie = np.empty(len(able), dtype=np.int64)
                s = score[able, slot]
                tie[np.lexsort((doc[able, slot], np.where(np.isnan(s), np.inf, s)))] = np.arange(len(able))
                key = whole[np.ix_(rows, able)] * np.int64(len(able)) + tie[None, :]
                part = np.argpartition(key, kk - 1, axis=1)[:, :kk]
                pick = able[part].reshape(-1)
                at = np.repeat(rows, kk)
                out.append(pd.DataFrame({
                    "ucls": some["ucls"].to_numpy(dtype=np.int64)[at], "slot": np.int32(slot), "need": np.int32(need),
                    "cls": cls[pick], "sim": -whole[at, pick] / 10.0 ** SIM_DIGITS, "b_score": score[pick, slot], "b_doc": doc[pick, slot]}))
        return pd.concat(out, ignore_index=True)
    return fn


def _classes(vectors: DataFrame, meta: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents with equal vectors form a class, named by its smallest document.

    Returns documents (doc, cls, code, grade), the classes' vectors (cls,
    terms, ws), members (cls, crank, code, score, doc) and the classes that
    have members (cls, terms, ws, is_open, b_score, b_doc). Members
    are the documents that can be among a target's first k: of a class and
    grade the first k + 1 codes and their first k documents, so that k are
    left whichever code the target has. The class arrays tell its first
    document for each of the five grade limits (better than b, c, d, e; any)."""
    entries = F.array_sort(F.collect_list(F.struct("term", F.round("w", 12).alias("rounded"), "w")))
    sparse = vectors.groupBy("doc").agg(entries.alias("tw"))
    rank_map = F.create_map(*sum([[F.lit(g), F.lit(i)] for i, g in enumerate("abcde")], []))
    grade = F.lower(F.col("grade"))
    docs = meta.withColumn("listed", F.lit(True)).join(sparse, "doc", "full").select(
        "doc", "listed", F.trim(F.col("code").cast("string")).alias("code"), F.trim(grade).alias("grade"),
        F.coalesce(F.element_at(rank_map, grade), F.lit(99)).alias("crank"), F.col("score").cast("double").alias("score"),
        F.coalesce(F.col("tw.term"), F.array().cast("array<string>")).alias("terms"),
        F.coalesce(F.col("tw.w"), F.array().cast("array<double>")).alias("ws"),
        F.sha2(F.to_json(F.struct(F.col("tw.term").alias("t"), F.col("tw.rounded").alias("w"))), 256).alias("sig"))
    docs = materialize(docs)
    named = materialize(docs.groupBy("sig").agg(F.min("doc").alias("cls")))
    docs = docs.join(named, "sig")
    vec = docs.where(F.col("doc") == F.col("cls")).select("cls", "terms", "ws")

    order = F.struct(F.col("score").isNull().alias("none"), "score", "doc")
    own = F.coalesce(F.concat(F.lit("c"), "code"), F.concat(F.lit("d"), F.col("doc").cast("string")))
    by_code = Window.partitionBy("cls", "crank", "own").orderBy("order")
    first = (docs.where("listed").select("cls", "crank", "code", "score", "doc", own.alias("own"), order.alias("order"))
             .withColumn("rn", F.row_number().over(by_code)).where(F.col("rn") <= k))
    codes = (first.where(F.col("rn") == 1)
             .withColumn("cn", F.row_number().over(Window.partitionBy("cls", "crank").orderBy("order")))
             .where(F.col("cn") <= k + 1).select("cls", "crank", "own"))
    members = materialize(first.join(codes, ["cls", "crank", "own"]).select("cls", "crank", "code", "score", "doc"))

    best = members.groupBy("cls").agg(*[F.min(F.when(F.col("crank") < lim, order)).alias(f"b{i}")
                                        for i, lim in enumerate(LIMITS)])
    each = [F.col(f"b{i}") for i in range(len(LIMITS))]
    best = best.select("cls", F.array(*[b.isNotNull() for b in each]).alias("is_open"),
                       F.array(*[F.coalesce(b["score"], F.lit(float("nan"))) for b in each]).alias("b_score"),
                       F.array(*[F.coalesce(b["doc"], F.lit(-1)) for b in each]).alias("b_doc"))
    return docs.select("doc", "cls", "code", "grade"), vec, members, materialize(vec.join(best, "cls"))


LIMITS = [1, 2, 3, 4, 100]  # grade ranks below these are eligible; the last: any


def _first_classes(hits: DataFrame) -> DataFrame:
    # A missing score is NaN in the JVM and null where it comes from pandas.
    order = [F.col("sim").desc(), F.coalesce(F.nanvl("b_score", F.lit(float("inf"))), F.lit(float("inf"))), F.col("b_doc")]
    return (hits.withColumn("rank", F.row_number().over(Window.partitionBy(*UNIT).orderBy(*order)))
            .where(F.col("rank") <= F.col("need")))


def _by_postings(prefix: DataFrame, postings: DataFrame, units: DataFrame, classes: DataFrame) -> DataFrame:
    """Hits among the classes that share a term of the unit's prefix (UNIT, term)."""
    pairs = prefix.join(postings.select("term", "cls"), "term").select(*UNIT, "cls").distinct()
    weights = units.select(*UNIT, F.map_from_arrays("terms", "ws").alias("w"))
    at = F.col("slot") + 1
    dot = F.aggregate(F.zip_with("terms", "ws", lambda t, x: x * F.coalesce(F.element_at(F.col("w"), t), F.lit(0.0))),
                      F.lit(0.0), lambda acc, x: acc + x)
    return (pairs.join(weights, UNIT).join(classes, "cls").where(F.element_at("is_open", at))
            .select(*UNIT, "cls", F.round(dot, SIM_DIGITS).alias("sim"),
                    F.element_at("b_score", at).alias("b_score"), F.element_at("b_doc", at).alias("b_doc")))


FEW_BLOCKS = 16
#: Query blocks that meet one copy of a block of classes.
BLOCKS_A_COPY = 16


def _compared(pairs: DataFrame, units: DataFrame, refs: DataFrame, query_block: int) -> DataFrame:
    """Hits of every (UNIT, rb): the unit against the classes of the block, ``BLOCKS_A_COPY`` times ``query_block`` units of a
    block in a group, as each group gets a copy of the block."""
    groups = pairs.groupBy("rb").agg(F.ceil(F.count("*") / F.lit(BLOCKS_A_COPY * query_block)).cast("int").alias("nqb"))
    q = units.join(pairs, UNIT).join(groups, "rb").withColumn("qb", F.pmod(F.xxhash64(*UNIT), F.col("nqb")).cast("int")).drop("nqb")
    r = refs.join(groups, "rb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nqb") - 1))).drop("nqb")
    return q.groupBy("rb", "qb").cogroup(r.groupBy("rb", "qb")).applyInPandas(_block_kernel(query_block), HITS)


def _by_blocks(units: DataFrame, classes: DataFrame, block: int, query_block: int) -> DataFrame:
    """Hits of units that rare terms do not settle, without a look at every block.

    Classes are dealt into blocks of about ``block`` by their heaviest terms, so that a block holds
    few different ones. What a unit can reach in a block is at most the sum of its weights times the
    block's largest weight of each term. A unit is compared with the block
    where that is highest, and then with those where it is not below the k-th similarity found there;
    a unit whose k-th similarity is 0, or that has no k yet, with all of them. Fewer than ``FEW_BLOCKS``
    blocks are all compared at once, as that is less work than the bounds.
    """
    n_blocks = max(1, -(-classes.count() // block))
    if n_blocks < FEW_BLOCKS:
        refs = classes.withColumn("rb", F.pmod(F.xxhash64("cls"), F.lit(n_blocks)).cast("int"))
        return _compared(units.select(*UNIT, F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("rb")), units, refs, query_block)
    heaviest = F.array_join(F.slice(F.transform(F.sort_array(F.arrays_zip("ws", "terms"), asc=False), lambda e: e["terms"]), 1, 4), " ")
    refs = materialize(classes.withColumn("_key", heaviest).repartitionByRange(n_blocks, "_key", "cls")
                       .withColumn("rb", F.spark_partition_id()).drop("_key"))
    most = refs.select("rb", F.inline(F.arrays_zip("terms", "ws"))).groupBy("rb", "terms").agg(F.max("ws").alias("most"))
    reach = units.select(*UNIT, F.inline(F.arrays_zip("terms", "ws"))).join(most, "terms").groupBy(*UNIT, "rb").agg(F.sum(F.col("ws") * F.col("most")).alias("bound"))
    reach = materialize(reach)
    own = materialize(reach.groupBy(*UNIT).agg(F.max_by("rb", F.struct("bound", -F.col("rb"))).alias("rb")))
    first = materialize(_compared(own, units, refs, query_block))
    kth = _first_classes(first).where(F.col("rank") == F.col("need")).select(*UNIT, F.col("sim").alias("kth"))
    slack = 10.0 ** -SIM_DIGITS
    settled = materialize(kth.where(F.col("kth") > slack))
    called = reach.join(settled, UNIT).where(F.col("bound") + slack >= F.col("kth")).select(*UNIT, "rb")
    last = refs.agg(F.max("rb")).first()[0] or 0
    every = units.select(*UNIT).join(settled, UNIT, "left_anti").withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(last))))
    more = called.unionByName(every).join(own, [*UNIT, "rb"], "left_anti")
    return first.unionByName(_compared(materialize(more), units, refs, query_block))


def _by_shared_blocks(rest: DataFrame, near: DataFrame, hits: DataFrame, classes: DataFrame, block: int, query_block: int) -> DataFrame:
    """Hits of the units ``rest``: those found by the postings of ``near`` and, over the unit's other terms, by blocks.

    A class that holds one of a unit's near terms is among ``hits`` if it is among the unit's first; any
    other class is as similar to the unit as to the unit without these terms. So units that differ only
    in near terms (a code, say) are compared with the blocks as one. A class found both ways
    counts with the postings' similarity, which is the whole one."""
    known = near.groupBy(*UNIT).agg(F.collect_set("term").alias("known"))
    e = F.arrays_zip("terms", "ws")
    others = F.when(F.col("known").isNull(), e).otherwise(F.filter(e, lambda x: ~F.array_contains("known", x["terms"])))
    sig = F.sha2(F.to_json(F.transform("others", lambda x: F.struct(x["terms"].alias("t"), F.round(x["ws"], 12).alias("w")))), 256)
    rest = materialize(rest.join(known, UNIT, "left").select(*UNIT, others.alias("others"))
                       .select(*UNIT, F.col("others.terms").alias("terms"), F.col("others.ws").alias("ws"), sig.alias("sig")))
    # a unit whose class is listed twice has two rows; it is compared as often as before it was shared
    own = rest.groupBy(*UNIT, "sig").agg(F.count("*").cast("int").alias("m"))
    alike = ["sig", "slot", "need", "m"]
    same = materialize(own.join(own.groupBy(*alike).agg(F.min("ucls").alias("one")), alike).select(*UNIT, "m", "one"))
    units = materialize(rest.join(same.where(F.col("ucls") == F.col("one")), UNIT, "left_semi").select(*UNIT, "terms", "ws"))
    first = materialize(_first_classes(_by_blocks(units, classes, block, query_block)).drop("rank"))
    release(first.sparkSession)
    each = same.drop("m").join(first.withColumnRenamed("ucls", "one"), ["one", "slot", "need"]).drop("one")
    by_postings = hits.drop("rank").join(same.select(*UNIT, "m"), UNIT)
    if -(-classes.count() // block) < FEW_BLOCKS:  # there each row of a unit meets each of its pairs
        by_postings = by_postings.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("m")))).drop("_copy")
    by_postings = by_postings.drop("m")
    return each.join(by_postings.select(*UNIT, "cls"), [*UNIT, "cls"], "left_anti").unionByName(by_postings)


def top_k_similar(targets: DataFrame, vectors: DataFrame, meta: DataFrame, k: int = 5,
                  better_only: bool = False, postings: int = 256, pair_cost: int = 64,
                  block: int = 2048, query_block: int = 512) -> DataFrame:
    """Exact top-k most similar documents per target.

    targets: (tid, doc) - doc is the target's key in ``vectors``.
    vectors: (doc, term, df, w) from ``tfidf_fit`` (key renamed ``doc``).
    meta:    (doc, code, grade, score) for every document, including those
             without tokens (they are eligible with similarity 0).
    Candidates exclude the target's trimmed code; with ``better_only`` and a
    target grade in a..e, only strictly better grades (unknown ranks 99).
    Order: similarity (rounded to SIM_DIGITS) desc, score asc (nulls last),
    doc asc. Returns (tid, rank, doc, similarite).

    The search is of *units* (class, grade limit, classes needed) against
    *classes* of equal vectors (module doc). ``postings`` is the number of
    candidates a unit may take from its rarest terms at first, sixteen times
    that once its k-th similarity is known; other units are compared in
    blocks (``_by_blocks``), as are those whose candidates, each ``pair_cost`` times the work of
    a pair in a block, would cost more than all classes do there. The choice
    is one of cost alone: every way is exact.
    """
    docs, shapes, members, classes = _classes(vectors, meta, k)
    # a target's own code can bar as many classes as hold it
    held = members.where(F.col("code").isNotNull()).groupBy("code").agg(F.count_distinct("cls").alias("held"))
    trank = F.array_position(F.array(*map(F.lit, "abcde")), F.col("grade")) - 1
    found = targets.select("tid", "doc").join(docs, "doc", "left")
    slot = F.when(F.lit(better_only) & (trank >= 0), trank - 1).otherwise(F.lit(len(LIMITS) - 1)).cast("int")
    found = (found.join(held, "code", "left")
             .select("tid", "code", F.coalesce("cls", "doc").alias("ucls"), slot.alias("slot"),
                     (F.lit(k) + F.coalesce("held", F.lit(1))).cast("int").alias("need")))
    found = materialize(found.where(F.col("slot") >= 0))  # nothing is better than the best grade
    no_terms, no_ws = F.array().cast("array<string>"), F.array().cast("array<double>")
    units = materialize(found.select(*UNIT).distinct().join(shapes.withColumnRenamed("cls", "ucls"), "ucls", "left")
                        .select(*UNIT, F.coalesce("terms", no_terms).alias("terms"), F.coalesce("ws", no_ws).alias("ws")))

    # rarest terms first: candidates by postings, and what all later terms can add at most
    lists = classes.select("cls", F.explode(F.arrays_zip("terms", "ws")).alias("e")).select("cls", "e.terms", "e.ws") \
        .toDF("cls", "term", "w")
    sizes = lists.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("most"))
    walk = Window.partitionBy(*UNIT).orderBy("n", "term")
    steps = (units.select(*UNIT, F.explode(F.arrays_zip("terms", "ws")).alias("e"))
             .select(*UNIT, F.col("e.terms").alias("term"), F.col("e.ws").alias("w")).join(sizes, "term")
             .withColumn("add", F.col("w") * F.col("most"))
             .select(*UNIT, "term", F.sum("n").over(walk).alias("cost"),
                     F.sum("add").over(walk.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("bound"),
                     (F.sum("add").over(walk.rowsBetween(Window.currentRow, Window.unboundedFollowing)) - F.col("add")).alias("after")))
    steps = materialize(steps)
    slack = F.lit(10.0 ** -SIM_DIGITS)  # ranks use rounded similarities
    n_classes = classes.select(F.count(F.lit(1))).scalar()
    worth = F.col("cost") * pair_cost <= n_classes
    near = steps.where((F.col("cost") <= postings) & worth)
    hits = materialize(_first_classes(_by_postings(near, lists, units, classes)))
    status = hits.where(F.col("rank") == F.col("need")).select(*UNIT, F.col("sim").alias("kth"))
    left = near.groupBy(*UNIT).agg(F.min("after").alias("after"))
    done = status.join(left, UNIT).where(F.col("kth") > F.col("after") + slack).select(*UNIT)
    # terms that the k-th similarity still calls for
    called = steps.join(status, UNIT).where(F.col("bound") + slack >= F.col("kth")).join(done, UNIT, "left_anti")
    cheap = called.groupBy(*UNIT).agg(F.max("cost").alias("cost")).where((F.col("cost") <= 16 * postings) & worth).select(*UNIT)
    cheap = materialize(cheap)
    more = _by_postings(called.join(cheap, UNIT).select(*UNIT, "term"), lists, units, classes)

    rest = units.join(done, UNIT, "left_anti").join(cheap, UNIT, "left_anti")
    settled = hits.drop("rank").join(done, UNIT)
    found_classes = settled.unionByName(more).unionByName(_by_shared_blocks(rest, near, hits, classes, block, query_block))

    # documents of the first classes, then each target without its own code
    order = [F.col("sim").desc(), F.col("score").asc_nulls_last(), F.col("doc").asc()]
    enough = F.lit(k) + (F.col("need") - k) * k
    rows = (_first_classes(found_classes).select(*UNIT, "cls", "sim").join(members, "cls")
            .where(F.col("crank") < F.element_at(F.array(*map(F.lit, LIMITS)), F.col("slot") + 1))
            .withColumn("rn", F.row_number().over(Window.partitionBy(*UNIT).orderBy(*order))).where(F.col("rn") <= enough)
            .withColumnRenamed("code", "ccode"))
    final = (found.join(rows, UNIT).where(F.col("code").isNull() | F.col("ccode").isNull() | (F.col("code") != F.col("ccode")))
             .withColumn("rank", F.row_number().over(Window.partitionBy("tid").orderBy(*order))).where(F.col("rank") <= k))
    return final.select("tid", "rank", "doc", F.col("sim").alias("similarite"))


def pair_similarity(a: Column, b: Column) -> Column:
    """TF-IDF fitted on the two texts only (no stop words), cosine,
    rounded to 3. With n = 2, idf is 1 for a term of both texts and
    ln(1.5) + 1 for a term of one; null when neither text has a token."""
    ta = F.regexp_extract_all(F.lower(F.coalesce(a, F.lit(""))), F.lit(TOKEN_PATTERN), 0)
    tb = F.regexp_extract_all(F.lower(F.coalesce(b, F.lit(""))), F.lit(TOKEN_PATTERN), 0)
    vocab = F.array_distinct(F.concat(ta, tb))
    idf_one = F.log(F.lit(1.5)) + F.lit(1.0)

    def weight(toks, t):
        tf = F.size(F.filter(toks, lambda x: x == t))
        both = F.array_contains(ta, t) & F.array_contains(tb, t)
        return tf * F.when(both, F.lit(1.0)).otherwise(idf_one)
    va = F.transform(vocab, lambda t: weight(ta, t))
    vb = F.transform(vocab, lambda t: weight(tb, t))
    dot = F.aggregate(F.zip_with(va, vb, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(va, F.lit(0.0), lambda acc, x: acc + x * x))
    nb = F.sqrt(F.aggregate(vb, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(F.size(vocab) == 0, F.lit(None).cast("double")) \
        .when((na == 0) | (nb == 0), F.lit(0.0)) \
        .otherwise(F.round(dot / (na * nb), 3))
