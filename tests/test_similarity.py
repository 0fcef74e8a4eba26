"""Exact text similarity by either way of search, against brute force."""

import math
import random

import pytest

from nutrilake.operators import textsim

K = 3


def brute(vectors, meta, targets, better):
    vec = {}
    for r in vectors:
        vec.setdefault(r.doc, {})[r.term] = r.w
    rank = {g: i for i, g in enumerate("abcde")}
    by_doc = {m[0]: m for m in meta}
    out = set()
    for tid, doc in targets:
        _, code, grade, _ = by_doc.get(doc, (doc, None, None, None))
        limit = rank.get((grade or "").strip().lower()) if better else None
        rows = []
        for d, c, g, s in meta:
            if code is not None and c is not None and code.strip() == c.strip():
                continue
            if limit is not None and rank.get((g or "").lower(), 99) >= limit:
                continue
            a, b = vec.get(doc, {}), vec.get(d, {})
            sim = round(sum(w * b.get(t, 0.0) for t, w in a.items()), textsim.SIM_DIGITS)
            rows.append((-sim, s is None, s or 0.0, d))
        out |= {(tid, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(rows)[:K])}
    return out


@pytest.mark.parametrize("better", [False, True])
@pytest.mark.parametrize("pair_cost", [0, 10 ** 9])  # all by postings where they decide; all by blocks
def test_top_k_equals_brute_force(spark, better, pair_cost):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(3, 8)) + ["common"] * (i % 3 == 0)) for i in range(90)]
    texts += texts[:25] + ["", "", "common", "zz"] + ["copy of one text"] * 30
    docs = [(i, t) for i, t in enumerate(texts)]
    vectors = textsim.tfidf_fit(spark.createDataFrame(docs, "doc long, text string"), "doc", "text")
    meta = [(i, None if i % 11 == 0 else f" c{i % 60}", "abcdeX"[i % 6] if i % 7 else None, None if i % 5 == 0 else float(i % 4))
            for i, _ in docs[:-1]]  # the last document has a text only
    targets = [(1000 + i, i) for i, _ in docs]
    got = textsim.top_k_similar(spark.createDataFrame(targets, "tid long, doc long"), vectors,
                                spark.createDataFrame(meta, "doc long, code string, grade string, score double"),
                                K, better, pair_cost=pair_cost, block=32, query_block=16)
    assert {tuple(r) for r in got.collect()} == brute(vectors.collect(), meta, targets, better)


def test_top_k_of_nothing(spark):
    docs = spark.createDataFrame([], "doc long, text string")
    got = textsim.top_k_similar(spark.createDataFrame([], "tid long, doc long"), textsim.tfidf_fit(docs, "doc", "text"),
                                spark.createDataFrame([], "doc long, code string, grade string, score double"), K)
    assert got.count() == 0


def test_blocks_out_of_reach_are_not_compared(spark, monkeypatch):
    """Forty subjects of their own words and some common ones: a unit meets few blocks, and loses nothing."""
    rnd = random.Random(11)
    texts = [" ".join([f"s{i % 40}x{j}" for j in rnd.sample(range(5), 3)] + rnd.choices(["all", "foods", "good"], k=2)) for i in range(600)]
    docs = list(enumerate(texts))
    vectors = textsim.tfidf_fit(spark.createDataFrame(docs, "doc long, text string"), "doc", "text").persist()
    meta = [(i, f"c{i}", "abcde"[i % 5], float(i % 7)) for i, _ in docs]
    targets = [(i, i) for i in range(0, 600, 7)]
    met = []
    compared = textsim._compared
    monkeypatch.setattr(textsim, "_compared", lambda pairs, units, refs, n: met.append((pairs.count(), refs.select("rb").distinct().count(), units.count()))
                        or compared(pairs, units, refs, n))
    got = textsim.top_k_similar(spark.createDataFrame(targets, "tid long, doc long"), vectors,
                                spark.createDataFrame(meta, "doc long, code string, grade string, score double"), K, pair_cost=10 ** 9, block=20, query_block=16)
    assert {tuple(r) for r in got.collect()} == brute(vectors.collect(), meta, targets, False)
    blocks, units = met[0][1], met[0][2]
    assert blocks > 15 and units > 50 and sum(pairs for pairs, _, _ in met) < 0.5 * blocks * units


def test_targets_that_differ_in_a_code_are_compared_as_one(spark, monkeypatch):
    words = ["red", "blue", "round", "flat", "sweet", "dry"]
    docs = [(i, f"code{i:03d} thing {words[i % 6]} {words[i // 6 % 6]}" + " thing" * (i % 4)) for i in range(90)]
    asked = [(-1 - i, f"which thing is code{i:03d}") for i in range(0, 90, 3)] + [(-500, "which red thing"), (-501, "nothing known")]
    vectors = textsim.tfidf_fit(spark.createDataFrame(docs + asked, "doc long, text string"), "doc", "text")
    meta = spark.createDataFrame([(i, None, None, None) for i, _ in docs], "doc long, code string, grade string, score int")
    seen, blocks = [], textsim._by_blocks

    def counted(units, *rest):
        seen.append(units.count())
        return blocks(units, *rest)
    monkeypatch.setattr(textsim, "_by_blocks", counted)
    got = textsim.top_k_similar(spark.createDataFrame([(d, d) for d, _ in asked], "tid long, doc long"), vectors, meta, 4, False,
                                pair_cost=1, postings=4, block=16, query_block=2).collect()
    held = {}
    for r in vectors.collect():
        held.setdefault(r.doc, {})[r.term] = r.w
    want = set()
    for a, _ in asked:
        sims = sorted((-round(sum(w * held.get(d, {}).get(t, 0.0) for t, w in held[a].items()), 9), d) for d, _ in docs)
        want |= {(a, rank + 1, d) for rank, (_, d) in enumerate(sims[:4])}
    assert {(r.tid, r["rank"], r.doc) for r in got} == want
    assert sum(seen) <= 4


def test_weights_with_few_and_many_frequent_terms(spark, monkeypatch):
    docs = [(1, "aa bb bb cc"), (1, "aa dd"), (2, "aa ee"), (3, ""), (4, None), (None, "aa bb"), (5, "bb ff gg")]
    df = spark.createDataFrame(docs, "doc long, text string")
    got = []
    for frequent in (1, 100_000):
        monkeypatch.setattr(textsim, "FREQUENT", frequent)
        got.append({(r.doc, r.term): (r.df, round(r.w, 12)) for r in textsim.tfidf_fit(df, "doc", "text").collect()})
    assert got[0] == got[1]
    held, n = {1: {"aa": 2, "bb": 2, "cc": 1, "dd": 1}, 2: {"aa": 1, "ee": 1}, 5: {"bb": 1, "ff": 1, "gg": 1}}, len(docs)
    dfreq = {"aa": 3, "bb": 3, "cc": 1, "dd": 1, "ee": 1, "ff": 1, "gg": 1}  # a missing key counts, but has no vector
    want = {}
    for d, tf in held.items():
        w = {t: f * (math.log((1 + n) / (1 + dfreq[t])) + 1) for t, f in tf.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want |= {(d, t): (dfreq[t], round(x / norm, 12)) for t, x in w.items()}
    assert got[0] == want


def test_repeated_documents_keep_their_rows(spark):
    """A document listed twice is among a target's first k twice, by postings and by blocks alike."""
    docs = [(i, f"code{i:03d} red thing" + " thing" * (i % 3)) for i in range(12)]
    asked = [(-1, "red code003"), (-2, "red code900")]
    vectors = textsim.tfidf_fit(spark.createDataFrame(docs + asked, "doc long, text string"), "doc", "text")
    meta = spark.createDataFrame([(i, None, None, None) for i, _ in docs for _ in range(2)], "doc long, code string, grade string, score int")
    got = []
    for pair_cost in (1, 10 ** 9):
        top = textsim.top_k_similar(spark.createDataFrame([(d, d) for d, _ in asked], "tid long, doc long"), vectors, meta, 4, False,
                                    pair_cost=pair_cost, postings=2, block=4, query_block=2)
        got.append(sorted((r.tid, r["rank"], r.doc, round(r.similarite, 9)) for r in top.collect()))
    assert got[0] == got[1] and len(got[0]) == 8
    assert [d for t, _, d, _ in got[0] if t == -1].count(3) > 1
