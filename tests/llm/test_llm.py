"""The training-data operators against brute force, round trips and held-out accuracy, on small and on awkward inputs."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from nutrilake.llm import bpe, embeddings, flatfiles, minhash, mixing, pii, quality, repeats, toxicity, wrappers
from tests.conftest import SF_ORACLE, SF_SMALL
from tests.harness import compare

SF_LARGE = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = public_tokenizers.path(bpe.VOCABULARY)
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
#: Nulls in any column, empty and very long texts, ties, repeated rows, and characters of all kinds.
AWKWARD = [
    (1, None, "en", "a", 0), (2, "", None, None, None), (3, LONG, "en", "a", 1), (4, LONG, "en", "b", 1), (5, "one two", "en", None, 7),
    (5, "one two", "en", None, 7), (None, "one two three four five six", "en", "a", 3), (6, "日本 😀 é\u0000\n\n \t x", "xx", "\U0001F600", 3),
    (7, "   \n\t ", "en", "b", 5), (8, "a" * 70_000, "en", "a", 2), (9, "mail a.b@c.de and +1 (988) 555-2485, 10.0.0.1", "en", "b", 2),
]


def awkward(spark, rows=AWKWARD):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", 1.5) for r in rows], DOCS + ", kept string, size double").repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def read(spark, name, sf=SF_ORACLE):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_registered(spark):
    assert {k.split("_")[0] for k in E.queries() if re.match(r"op\d", k)} == {f"op{n}" for n in range(1, 14)} and "pipeline" in E.queries()


@pytest.mark.parametrize("key", [k for k in E.oracle_sql() if re.match(r"op\d", k)])
def test_sql(spark, key):
    got = compare(spark, E.queries()[key], E.oracle_sql()[key], SF_ORACLE)
    assert got["values_match"], got


# 1

def classes_by_brute_force(rows, least=0.8, n=5):
    bags = {i: Counter(tuple(w[j:j + n]) for j in range(max(1, len(w) - n + 1))) if (w := words(t)) else Counter() for i, t in rows}
    inverted = defaultdict(list)
    for i, bag in bags.items():
        for g in bag:
            inverted[g].append(i)
    shared = {(a, b) for at in inverted.values() for x, a in enumerate(at) for b in at[x + 1:]}
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in shared:
        both = sum((bags[a] & bags[b]).values())
        if both >= least * sum((bags[a] | bags[b]).values()):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in bags}


def test_near_duplicates(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, "documents").collect()]
    got = {r.doc_id: (r.class_id, r.kept) for r in E.queries()["op1_near_duplicates"](spark, SF_ORACLE).collect()}
    assert got == {i: (c, i == c) for i, c in classes_by_brute_force(rows).items()}


def test_near_duplicates_apart_from_centre(spark):
    # a chain: each text is near the next one only, and a crowd of middling neighbours shares their buckets
    base = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(base[: 120 - 2 * i] + [f"u{j}" for j in range(2 * i)])) for i in range(30)]
    rows += [(100 + i, " ".join(base[:95] + [f"v{i}_{j}" for j in range(25)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == classes_by_brute_force(rows)


def test_near_duplicates_awkward(spark):
    got = sorted((str(r.doc_id), str(r.class_id), r.kept) for r in minhash.near_duplicates(awkward(spark)).collect())
    assert len(got) == len(AWKWARD) and got.count(("5", "5", True)) == 2
    assert ("4", "3", False) in got and ("None", "None", True) in got and ("1", "1", True) in got and ("7", "7", True) in got
    # rows of one doc_id unite their texts' classes
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "p q r s t u"), (3, "p q r s t u")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.class_id for r in got] == [1] * 4
    assert minhash.near_duplicates(awkward(spark, []).limit(0)).count() == 0


def test_dart_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(3)
    n = 300
    a, b = rng.integers(0, 5, n).astype(float), rng.integers(0, 5, n) * 0.75
    e = minhash.mix64(np.arange(n, dtype=np.uint64))
    doc = np.repeat([0, 1], [np.count_nonzero(a), np.count_nonzero(b)])
    sig = minhash.dart_signatures(doc, np.concatenate([e[a > 0], e[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


# 2

def test_toxicity(spark):
    """Held-out documents of the larger table; the smallest have too few positives (about 50) to learn four languages from."""
    rows = E.queries()["op2_toxicity"](spark, SF_LARGE).collect()
    assert len(rows) == read(spark, "documents", SF_LARGE).count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    label = {r.doc_id: r.toxic for r in read(spark, "labels", SF_LARGE).collect()}
    told = [(label[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in label]
    up, down = [s for t, s in told if t == 1], [s for t, s in told if t == 0]
    assert np.mean([[x > y for y in down] for x in up]) > 0.9 and np.mean([s < 0.5 for s in down]) > 0.95


def test_toxicity_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(5)
    toxic = np.arange(3000) % 10 == 0
    x = (rng.random((3000, 40)) < np.where(toxic[:, None] & (np.arange(40) < 8), 0.6, 0.05)).astype(np.uint8)
    known = np.flatnonzero(toxic)[:150]
    w, b = toxicity.fit_nnpu(np.concatenate([x[known], x]), np.concatenate([np.ones(150, bool), np.zeros(3000, bool)]), 0.1)
    guess = x @ w + b >= 0
    assert guess[toxic].mean() > 0.85 and guess[~toxic].mean() < 0.02  # the best possible is 0.95


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    docs = awkward(spark)
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).count() == 0


# 3

def repeats_by_brute_force(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s:s + length] in seen:
                gone[s:s + length] = True
            seen.add(b[s:s + length])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def removed(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_repeated_substrings(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, "documents", SF_SMALL).collect()]
    assert removed(E.queries()["op3_repeated_substrings"](spark, SF_SMALL)) == repeats_by_brute_force(rows, 100)


def test_repeated_substrings_hot_and_periodic(spark, monkeypatch):
    # small texts over two letters, periods, and one passage in nearly all of them; large groups from four runs on
    monkeypatch.setattr(repeats, "LARGE_IN_BATCH", 2)
    monkeypatch.setattr(repeats, "LARGE_GROUP", 4)
    monkeypatch.setattr(repeats, "ARRAY_STRINGS", 7)
    rng = np.random.default_rng(9)
    passage = "".join(rng.choice(list("abcdefgh"), 60))
    rows = [(i, "".join(rng.choice(list("ab"), 80)) + (passage if i % 4 else "ab" * 30) + "".join(rng.choice(list("abcé"), 30))) for i in range(60)]
    rows += [(70, "ab" * 200), (71, "a" * 300), (72, "a" * 300), (73, "\x00" * 50), (74, "\x00" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert removed(repeats.remove_repeats(docs, 20, 6)) == repeats_by_brute_force(rows, 20)


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("parts", [1, 4])
def test_repeated_substrings_equal_rows(spark, monkeypatch, large, parts):
    # equal rows of one document within a batch and apart, whose text is also in a later document and partly in an earlier one
    if large:
        monkeypatch.setattr(repeats, "LARGE_IN_BATCH", 1)
        monkeypatch.setattr(repeats, "LARGE_GROUP", 2)
    rng = np.random.default_rng(12)
    one, two, three = ("".join(rng.choice(list("abcdefgh"), 400)) for _ in range(3))
    rows = [(2, one), (3, one[150:] + two), (4, two[:250]), (5, three), (6, one[:200] + three[:180]), (8, "ab" * 150)]
    given = rows * 3 + [(9, one)]
    order = [int(i) for i in rng.permutation(len(given))]
    docs = spark.createDataFrame([given[i] for i in order], "doc_id long, text string").repartition(parts)
    got = repeats.remove_repeats(docs)
    assert got.count() == len(given)
    truth = repeats_by_brute_force([*rows, (9, one)], 100)
    assert truth[5][1] == 0 and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == truth[r.doc_id] for r in got.collect())


def test_repeated_substrings_awkward(spark):
    got = repeats.remove_repeats(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[1][0].n_bytes == 0 and by[4][0].n_removed == by[4][0].n_bytes and by[8][0].n_removed == 70_000 - 1 and len(by[5]) == 2
    assert repeats.remove_repeats(awkward(spark, []).limit(0)).count() == 0


def test_maximal_repeats_have_all_occurrences():
    array = repeats.SuffixArray([b"xabcdy", b"zabcdw", b"qabcdy"], 3)
    found = {(d, frozenset((int(array.string[i]), int(array.offset[i])) for i in range(lo, hi))) for d, lo, hi in array.maximal_repeats(3)}
    assert (4, frozenset({(0, 1), (1, 1), (2, 1)})) in found and (5, frozenset({(0, 1), (2, 1)})) in found
    assert not any(d == 3 and len(at) == 3 for d, at in found)  # bcd is always preceded by a


# 4

def test_cascade_order_and_verdict(spark):
    docs = read(spark, "documents").select("doc_id", "text")
    stats = {r["rule"]: r for r in quality.rule_statistics(docs).collect()}
    order = [r.name for r in quality.cascade_order(docs)]
    assert sorted(order) == sorted(r.name for r in quality.RULES) and all(stats[n]["rows"] == stats[order[0]]["rows"] for n in order)
    forward, back = (quality.cascade(docs, rules, base=()).where("kept").count() for rules in (quality.RULES, quality.RULES[::-1]))
    assert forward == back == E.queries()["op4_quality_rules"](spark, SF_ORACLE).where("kept").count()


def test_pipeline_orders_all_rules(spark, monkeypatch):
    seen = []
    cascade = quality.cascade
    monkeypatch.setattr(quality, "cascade", lambda docs, **given: seen.append(given) or cascade(docs, **given))
    docs = read(spark, "documents")
    kept = corpus_pipeline.quality_rules(spark, docs, SF_ORACLE)
    assert seen == [{"base": ()}] and kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in cascade(docs).where("kept").collect()}


def test_quality_awkward(spark):
    got = quality.cascade(awkward(spark), figures=quality.BASE_FIGURES).collect()
    assert len(got) == len(AWKWARD) and "kept" in got[0].asDict()
    one = {r.doc_id: r for r in got}
    assert one[1].n_words == 0 and one[3].n_words == 60_000 and one[8].word_chars == 70_000 and one[7].base_failed
    assert quality.cascade(awkward(spark).limit(0)).count() == 0


# 5

PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href=/a>A{0}</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id=ad-1>Buy {0}</div><script>var t="</p>";</script>
<{1}><h1>Title {0}</h1><p>One &amp; <b>two{0}</b><br>three\n  four<p>Five<form><input>x</form><ul><li>item</ul><div class="comments"><p>Me {0}</p></div></{1}>
<aside>Side {0}</aside><footer>&copy; me</footer>{2}"""


@pytest.mark.parametrize("box", ["article", "main", 'div class="post"'])
def test_main_text(spark, box):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(i, box, "</body></html>" if i % 3 else "").replace(f"</{box}>", f"</{box.split()[0]}>")) for i in range(8)]
    got = {r.page_id: r for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i].text == f"Title {i} One & two{i} three four Five item" and got[i].n_chars == len(got[i].text)


def test_main_text_without_marks(spark):
    page = "<body><div class=top>Home page of all</div><div><p>Story {0} is told here at length</p><p>More {0}</p></div><div>Same end for all</div></body>"
    rows = [(i, "http://h.example/", page.format(i)) for i in range(5)]
    got = wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Story {i} is told here at length More {i}" for i in range(5)}


def test_main_text_of_copies(spark):
    # copies of one page, in one batch and apart; and three pages, one of which has nothing of its own
    page = "<body><div class=top>Home</div><div>Story is told here<br>at length</div></body>"
    other = "<body><div class=top>Home</div><div>Other {0}</div></body>"
    rows = [(i, f"http://h.example/?print={i}", page) for i in range(8)]
    rows += [(10 + i, "http://i.example/", other.format(i)) for i in range(4)] + [(20, "http://i.example/", "<body><div class=top>Home</div></body>")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 4):
        got = {r.page_id: r.text for r in wrappers.main_texts(pages.repartition(parts)).collect()}
        assert [got[i] for i in range(8)] == ["Home Story is told here at length"] * 8
        assert [got[10 + i] for i in range(4)] == [f"Other {i}" for i in range(4)] and got[20] == "Home"


def own_text(page):
    return wrappers.extract(page, wrappers.json.dumps(wrappers.wrapper_of(wrappers.parse(page))))


@pytest.mark.parametrize("page", [
    "<div class=content><h1>Title</h1><div class=post-body><p>{0}</p></div><p>End</p></div>",
    "<main><h1>Title</h1><article><p>{0}</p></article><p>End</p></main>",
    "<div><div class=post-intro>Title</div><div class=post-body>{0}</div><div class=post-end>End</div></div><div>Else</div>",
    "<article class=a>Title</article><article class=b>{0}</article><article class=c>End</article><div>Else</div>",
    "<article><h1>Title</h1>{0}<nav>Go</nav><p>End</article><div>" + "Else " * 400 + "</div>",
])
def test_main_text_drops_nothing_marked(page):
    story = "A story of some length. " * 20
    assert own_text(f"<body>{page.format(story)}</body>") == f"Title {story}End"


@pytest.mark.parametrize("depth", [10, 80, 3000])
def test_main_text_at_any_depth(depth):
    deep = "<div>" * depth
    assert own_text(deep + "<p>Text <nav><div>Menu</div></nav><p>More<div class=ad-1>Buy<div class=content>this</div></div><form>Ask</form><p>End") == "Text More End"
    assert own_text("<p>Before</p>" + deep + "<article><h1>Title</h1><footer>Me</footer><p>Story</article><p>After") == "Title Story"
    assert own_text(deep + "<nav><article>" * depth + "Go") == ""


def test_main_text_of_pages(spark):
    html = {r.page_id: r.html for r in read(spark, "pages").collect()}
    got = E.queries()["op5_main_text"](spark, SF_ORACLE).collect()
    assert len(got) == len(html)
    for r in got:
        body = re.search(r"<article>(.*?)(</article>|\Z)", html[r.page_id], re.S)[1]
        parts = [re.sub(r"[\t-\r ]+", " ", wrappers.entities.unescape(re.sub("</?b>", "", x))).strip(" ") for x in re.split("</?(?:p|h1|br)>", body)]
        assert r.text == " ".join(x for x in parts if x)


def test_wrapper_is_a_union_free_expression():
    a, b = (wrappers.wrapper_of(wrappers.parse(h)) for h in ("<div><p>x<p>y</div><nav>m</nav>", "<div><p>x</div><aside>n</aside><nav>m</nav>"))
    w = wrappers.joined(a, b)
    assert [(p[wrappers.KEY], p[wrappers.MANY]) for p in w[wrappers.PARTS]] == [("div>p", ""), ("aside", "?"), ("nav", "")]
    assert w[wrappers.PARTS][0][wrappers.PARTS][0][wrappers.MANY] == "+"


def test_pages_awkward(spark):
    rows = [(1, None, None), (2, "x", ""), (None, "http://h/", "<p>a"), (3, "http://h/", "<" * 5000), (4, "http://h/", "<div>" * 5000 + "deep"),
            (5, "http://h/", '<article class="a' + "x" * 1000), (6, "http://h/", "plain &lt; text"), (6, "http://h/", "plain &lt; text"),
            (7, "http://h/", "<article>" + "<h2>h</h2><p>t</p>" * 20000 + "</article>")]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, text string")
    got = wrappers.main_texts(pages).collect()
    assert len(got) == len(rows) and next(r for r in got if r.page_id == 7).text == " ".join(["h t"] * 20000)
    assert next(r for r in got if r.page_id == 1).text == ""
    assert wrappers.main_texts(pages.limit(0)).count() == 0


# 6

def test_mix_comes_near_its_targets(spark):
    mix = E.queries()["op6_source_mix"](spark, SF_ORACLE).join(read(spark, "documents").select("doc_id", "source"), "doc_id")
    for r in mix.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.max("size").alias("m")).collect():
        assert abs(r.t - r.n) <= 2 * r.m
    assert mix.where("taken > 3 * size or taken % greatest(size, 1) != 0").isEmpty()


def test_mix_awkward(spark):
    rows = [(r.doc_id, r.size, r.source_size, r.taken) for r in mixing.fair_mix(awkward(spark)).collect()]
    assert len(rows) == len(AWKWARD) and sum(r[3] for r in rows) <= sum(r[1] for r in rows)
    out = mixing.mixed(awkward(spark))
    assert sum(len(words(r.text)) for r in out.collect()) == sum(r[3] for r in rows) and out.columns == awkward(spark).columns
    assert mixing.fair_mix(awkward(spark).limit(0)).count() == 0


def test_capped_targets(spark):
    sources = spark.createDataFrame([("a", 10, 1), ("b", 10, 2), ("c", 1000, 3), ("d", 0, 1)], "source string, source_size long, weight int")
    got = {r.source: r.target for r in mixing.capped_targets(sources, 1020, 3).collect()}
    assert got == {"a": 30.0, "b": 30.0, "c": 960.0, "d": 0.0}


# 7 and 8

def tiktoken_encoding():
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_is_tiktokens(spark):
    theirs, ours = tiktoken_encoding(), bpe.ByteBpe(VOCABULARY, public_tokenizers.PATTERN)
    texts = [r.text for r in read(spark, "documents").collect()] + [r[1] or "" for r in AWKWARD if r[1] != "a" * 70_000]
    texts += ["", " ", "  a  b ", "a\n  b", "foo\n \nx", "　 x  y", "it's we'LL 's", "Ⅻ²³ ๑๒", "🏳️‍🌈" * 20, "\x1c\x1d a \x85 b", "<|endoftext|>"]
    ours.runs.most = ours.pieces.most = 500  # turn the memory over again and again
    for text, got in zip(texts, ours.encode(texts)):
        ids = np.frombuffer(got, "<u4")
        assert ids.tolist() == theirs.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()
    split = np.frombuffer(ours.encode(["日本😀x"])[0], "<u4")
    assert "".join(ours.decode_stream(split.tolist())) == "日本😀x" and len(ours.offsets("日本😀x")) == len(split)
    assert ours.offsets("日本😀x")[-1][1] == 4


def test_round_trip_query(spark):
    theirs = tiktoken_encoding()
    text = {r.doc_id: r.text for r in read(spark, "documents", SF_SMALL).collect()}
    for r in E.queries()["op8_byte_bpe"](spark, SF_SMALL).collect():
        ids = np.array(theirs.encode_ordinary(text[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_encode_decode_awkward(spark):
    there = bpe.encode(awkward(spark), VOCABULARY, public_tokenizers.PATTERN)
    for r in bpe.decode(there, VOCABULARY, public_tokenizers.PATTERN).collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.round_trip(awkward(spark).limit(0), VOCABULARY, public_tokenizers.PATTERN, ids="ids").count() == 0


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_separator_scan_blocks(block):
    rng = np.random.default_rng(block)
    sizes = rng.integers(0, 9, 40)
    docs = [rng.integers(0, 50_000, n) for n in sizes]
    flat = np.concatenate([np.concatenate([d, [50256]]) for d in docs] + [np.array([7, 8])]).astype(">u2").tobytes()
    assert flatfiles.scan_file(flat, 50256, 0, block)[0].tolist() == [*sizes, 2]
    heads = flatfiles.id_tokens(pa.array([None, *range(-4, 35)], pa.int64()))
    flat = b"".join(h.tobytes() + d.astype(">u2").tobytes() + b"\xc4\x50" for h, d in zip(heads, docs))
    for content in (flat, zlib.compress(flat, wbits=31), zlib.compress(flat[:100], wbits=31) + zlib.compress(flat[100:], wbits=31)):
        counts, found = flatfiles.scan_file(content, 50256, flatfiles.ID_TOKENS, block)
        assert counts.tolist() == sizes.tolist() and flatfiles.ids_of(found).to_pylist() == [None, *range(-4, 35)]


def test_token_counts(spark):
    theirs = {r.doc_id: r.n_tokens for r in E.queries()["op8_byte_bpe"](spark, SF_ORACLE).collect()}
    assert {r.doc_id: r.n_tokens for r in E.queries()["op7_token_counts"](spark, SF_ORACLE).collect()} == theirs
    path = flatfiles.scratch_folder(spark, "test")
    flatfiles.write_token_files(awkward(spark), path, VOCABULARY, public_tokenizers.PATTERN, 50256)
    got = sorted((str(r.doc_id), r.n_tokens) for r in flatfiles.separator_scan(spark, path, 50256, with_ids=True).collect())
    enc = bpe.ByteBpe(VOCABULARY, public_tokenizers.PATTERN)
    assert got == sorted((str(r[0]), len(enc.encode([r[1] or ""])[0]) // 4) for r in AWKWARD)
    flatfiles.drop_folder(spark, path)


# 9

def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = [(i, [float(x) for x in base[i % 60] + 0.02 * rng.normal(size=16) * (i >= 60)], i % 3) for i in range(400)]
    rows += [(400 + i, [float(x) for x in base[0]], 0) for i in range(50)]
    bad = [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [float("nan")] + [1.0] * 15, 1), (504, [None] + [1.0] * 15, 1),
           (505, [float("inf")] + [1.0] * 15, 1), (506, rows[0][1], None), (None, rows[0][1], 0), (507, [1.0, 2.0], 1)]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    links = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(links, False)
    root = np.arange(len(rows))
    for _ in range(len(rows)):
        new = np.minimum(root, np.where(links, root[None], len(rows)).min(axis=1))
        if (new == root).all():
            break
        root = new
    found = np.array([got[r[0]].n_links for r in rows])
    assert (found <= links.sum(axis=1)).all() and found.sum() >= 0.9 * links.sum()
    assert np.mean([got[r[0]].component_id == rows[c][0] for r, c in zip(rows, root)]) > 0.95
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(500, 508)) and got[None].kept
    assert len(got) == len(rows) + len(bad)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_vectors(empty).count() == 0


@pytest.mark.parametrize("least", [4, 1024])
def test_embeddings_of_several_lengths(spark, monkeypatch, least):
    monkeypatch.setattr(embeddings.centroids, "__defaults__", (embeddings.SAMPLE, least))
    rng = np.random.default_rng(6)
    rows = []
    for d, n in ((16, 60), (5, 20), (9, 3)):
        base = rng.normal(size=(n, d))
        rows += [(len(rows) + i, [float(x) for x in base[i % n] + 0.001 * rng.normal(size=d)], 0) for i in range(2 * n)]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) for r in rows]
    links = [sum(len(u) == len(v) and u @ v >= 0.98 for v in unit) - 1 for u in unit]
    assert min(links) >= 1 and [got[i].n_links for i in range(len(rows))] == links


# 10

BASE = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == 1:
        return all(int(p) <= 255 for p in match.split("."))
    if kind == 2:
        return 12 <= len(digits) <= 19 and sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(digits[::-1])) % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def base_by_brute_force(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(BASE) for m in p.finditer(text) if passes(k, m[0]))


def test_base_spans():
    rng = np.random.default_rng(8)
    for _ in range(5000):
        text = "".join(rng.choice(list("ab@.@..1234567 90-+()_é\n"), rng.integers(0, 45)))
        assert pii.base_spans(text) == base_by_brute_force(text)
    assert pii.base_spans("4" * 100_000 + "@" * 50_000 + "." * 1000) == []
    assert pii.base_spans("0" * 9000 + ".1.2.3") == [(0, 1, 9006)]


def test_personal_data(spark):
    text = {r.doc_id: r.text for r in read(spark, "documents").collect()}
    rows = E.queries()["op10_personal_data"](spark, SF_ORACLE).collect()
    assert len(rows) == len(text)
    for r in rows:
        base = base_by_brute_force(text[r.doc_id])
        said = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= set(r.spans.split(",") if r.spans else [])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]


def test_field_spreads_labels_over_repeats():
    nothing = np.zeros((0, 2), np.int64)
    field = pii.fit_field(np.array([1, 2, 2]), np.array([4, 0, 0]), nothing, nothing)
    one, two = (pii.marginals(field, np.array([1, 9, 9]), np.array([4, 0, 0]), nothing, np.array(e, np.int64).reshape(-1, 2)) for e in ([], [[0, 1]]))
    assert one[1, 4] < 0.1 < 0.95 < two[1, 4] and two[2, 4] < 0.1
    assert pii.replaced("a b@c.d e", [(2, 0, 7)]) == "a [EMAIL] e"


@pytest.mark.parametrize("others", [1, 2, 49])
@pytest.mark.parametrize("found_at", [0, 1])
def test_field_links_every_mention(others, found_at):
    # one mention that a pattern finds and further ones that none does, with plain words between
    number = "5551234567"
    mentions = [f"call {number} again"] * others
    mentions.insert(found_at, "call +15551234567 now")
    text = " and then ".join(mentions)
    base = pii.base_spans(text)
    nodes = pii.nodes_of(text, base)
    assert len(base) == 1 and not nodes.chain and {x for e in nodes.skip for x in e} == set(range(others + 1))
    empty = np.zeros((0, 2), np.int64)
    field = pii.fit_field(np.zeros(0, np.int64), np.zeros(0, np.int64), empty, empty)
    [(_, spans)] = pii.all_spans(field, [text])
    assert spans == sorted(base + [(m.start(), 3, m.end()) for m in re.finditer(rf"(?<!\+1){number}", text)])


def test_field_chain_edge_stands_for_skip_edge():
    nodes = pii.nodes_of("a1 a1 word a1", [])
    assert (nodes.chain, nodes.skip) == ([(0, 1)], [(0, 2)])
    assert len(pii.nodes_of("x a1 y " * 500, []).skip) == 499


def test_personal_data_awkward(spark):
    field = pii.learn_field(awkward(spark))
    got = pii.find(awkward(spark), field).collect()
    assert len(got) == len(AWKWARD) and next(r for r in got if r.doc_id == 9).n_phone == 1
    out = pii.redact(awkward(spark), field)
    assert out.columns == awkward(spark).columns and "[EMAIL]" in out.where("doc_id = 9").first().text
    assert pii.find(awkward(spark).limit(0), pii.learn_field(awkward(spark).limit(0))).count() == 0


# pipeline

def test_pipeline(spark):
    docs = read(spark, "documents", SF_SMALL)
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in E.queries()["op4_quality_rules"](spark, SF_SMALL).where("kept").collect()}
    by = classes_by_brute_force([(i, rows[i].text) for i in kept])
    first = {i for i in kept if by[i] == i}
    stage = docs
    seen = []
    for _, f in corpus_pipeline.STAGES:
        path = flatfiles.scratch_folder(spark, "test")
        f(spark, stage, SF_SMALL).write.parquet(path)
        stage = spark.read.parquet(path)
        seen.append(stage)
    assert all(s.columns == docs.columns for s in seen[:-1])
    assert {r.doc_id for r in seen[0].collect()} == kept and sorted(r.doc_id for r in seen[1].collect()) == sorted(first)
    for r in seen[2].collect():
        spans = base_by_brute_force(rows[r.doc_id].text)
        assert (r.text == rows[r.doc_id].text) == (not spans) or not spans
        assert base_by_brute_force(r.text) == [] and r.n_chars == len(r.text)
    mix = Counter(r.doc_id for r in seen[3].collect())
    assert set(mix) <= first and max(mix.values()) <= 3
    theirs, text = tiktoken_encoding(), {r.doc_id: r.text for r in seen[2].collect()}
    last = seen[4].collect()
    assert Counter(r.doc_id for r in last) == mix and all(list(r.ids) == theirs.encode_ordinary(text[r.doc_id]) for r in last)
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF_SMALL).collect()) == sorted((r.doc_id, r.ids_sha256) for r in last)


def test_pipeline_awkward(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = AWKWARD + [(20, good, "en", None, 1), (20, good, "en", None, 1), (None, good + " z", None, "a", None), (None, good + " z", None, "a", None)]
    for given in (rows, []):
        stage = awkward(spark, given) if given else awkward(spark).limit(0)
        for _, f in corpus_pipeline.STAGES:
            path = flatfiles.scratch_folder(spark, "test")
            f(spark, stage, SF_SMALL).write.parquet(path)
            stage = spark.read.parquet(path)
        assert bool(stage.count()) == bool(given)
