"""Keyword search and regular-expression search against brute force."""

import random
import re

import pytest

from nutrilake.operators import keywords, regexsearch

FIELDS = {"code": 8, "name": 4, "kind": 2, "place": 1, "grade": 1}


def words(text):
    return {w for w in re.findall(r"[^\W_]+", (text or "").lower())}


def page(text, products, size):
    ranked = []
    for p in products:
        points = {}
        for field, n in FIELDS.items():
            for w in words(p[field]):
                points[w] = max(points.get(w, 0), n)
        hit = words(text) & points.keys()
        if hit:
            ranked.append((-len(hit), -sum(points[w] for w in hit), p["code"]))
    return [(i + 1, key, -n, -s) for i, (n, s, key) in enumerate(sorted(ranked)[:size])]


@pytest.mark.parametrize("size", [1, 3, 5])
def test_keyword_search_equals_brute_force(spark, size):
    rng = random.Random(size)
    vocabulary = ["foods", "bio"] * 12 + [f"w{i}" for i in range(25)] * 2 + [f"rare{i}" for i in range(30)]

    def text(n):
        return None if rng.random() < 0.1 else " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(n + 1)))
    products = [{"code": f"c{i:03}", "name": text(4), "kind": text(2), "place": text(1), "grade": text(1)} for i in range(150)]
    asked = [(i, text(7)) for i in range(120)] + [(200, ""), (201, None), (202, "nothing known"), (203, "Foods, BIO!"), (204, "c007 bio"), (205, "bio foods"), (203, "w1")]
    found = keywords.keyword_search(spark.createDataFrame(asked, "q long, t string"), "q", "t",
                                    spark.createDataFrame([tuple(p[f] for f in FIELDS) for p in products], ", ".join(f"{f} string" for f in FIELDS)).repartition(3),
                                    "code", FIELDS, size)
    whole = {}
    for q, t in asked:  # rows that share an id are one request
        whole[q] = f"{whole.get(q, '')} {t or ''}"
    want = sorted((q, *r) for q, t in whole.items() for r in page(t, products, size))
    assert sorted(map(tuple, found.select("q", "pos", "code", "n_words", "points").collect())) == want


def test_keyword_search_of_nothing(spark):
    requests = spark.createDataFrame([(1, "bio")], "q long, t string")
    products = spark.createDataFrame([("a", "bio", None, None, None)], ", ".join(f"{f} string" for f in FIELDS))
    for q, p in ((requests.limit(0), products), (requests, products.limit(0))):
        assert keywords.keyword_search(q, "q", "t", p, "code", FIELDS).isEmpty()


LITERALS = [("hot gear", [("hot gear",)]), ("gr[ae]y", [("gray", "grey")]), ("(old|new) bolt", [("new bolt", "old bolt")]), ("a.c", [("a",), ("c",)]), (r"\d+", []), ("x*", []),
            ("(?:ab)+c", [("ab",), ("c",)]), ("abc?d", [("abcd", "abd")]), ("^Start", [("start",)]), ("foo.*|bar.+", [("bar", "foo")]), ("[^a]bc", [("bc",)]), ("a|", []),
            ("(", []), ("(?=abc)d", [("d",)]), ("é|a", []), ("(?x)a b", [])]


@pytest.mark.parametrize("pattern, want", LITERALS)
def test_required_literals(pattern, want):
    assert regexsearch.required_literals(pattern) == want


def test_required_literals_never_lose_a_match():
    rng = random.Random(2)
    pieces = ["a", "b", "ab", "bio", ".", "[ab]", "[^a]", "a?", "(ab)?", "(a|b)", "(ab|ba|i)", "b+", "(ab)*", "^", "$", r"\b", r"\d", "s", "k", "I", "{2}", "a{2}", "é", " ", "(?:ab|a(b|.)c)", "(?i:S)", "x{0}"]
    letters = "abAB iIsSkKc1éÉıİſK"
    tried = 0
    for _ in range(4000):
        pattern = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))
        rule = regexsearch.compiled(pattern)
        if rule is None:
            continue
        clauses = regexsearch.required_literals(pattern)
        for _ in range(6):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(12)))
            if rule.search(text):
                tried += 1
                low = text.replace("İ", "i").lower().replace("ı", "i").replace("ſ", "s")
                assert all(any(s in low for s in clause) for clause in clauses), (pattern, text, clauses)
    assert tried > 3000


def test_regex_matches_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(regexsearch, "PATTERN_BLOCK", 2)
    rng = random.Random(3)
    texts = [(i, None if i % 17 == 0 else " ".join(rng.choice(["hot", "Old", "grey", "gray", "bolt", "İs", "K2", "a.b", "12"]) for _ in range(rng.randrange(4)))) for i in range(120)]
    patterns = ["hot", "gr[ae]y b", "(old|hot) gr", r"^\S+$", r"\d+", ".", "", "a.b", r"a\.b", "(", None, "^is", "k", "OLD.*bolt", "[^o]ld", "bolt$", "nothing", "x{0}"]
    got = regexsearch.regex_matches(spark.createDataFrame(list(enumerate(patterns)), "q long, p string"), "q", "p",
                                    spark.createDataFrame(texts, "id long, t string").repartition(3), "id", "t", 4)
    want = []
    for q, p in enumerate(patterns):
        if p is not None and p != "(":
            hits = [i for i, t in texts if t is not None and re.search(p, t, re.IGNORECASE)]
            want += [(q, i, n + 1) for n, i in enumerate(hits[:4])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    empty = spark.createDataFrame([], "id long, t string")
    assert regexsearch.regex_matches(spark.createDataFrame([(1, "a"), (2, ".")], "q long, p string"), "q", "p", empty, "id", "t", 4).isEmpty()
