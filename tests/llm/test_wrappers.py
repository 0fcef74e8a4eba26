"""The article by inferred wrappers: names as a prior, slots where nothing is marked, bounded alignment."""

import json
import random
import time

import pytest

from nutrilake.llm import wrappers

STORY = "A story that is told here at some length, with {0}. " * 7


def texts_of(pages, infer=True):
    """Every page read along the wrapper of all of them."""
    wrapper = json.dumps(wrappers.merged(wrappers.wrapper_of(wrappers.parse(p)) for p in pages))
    return [wrappers.extract(p, wrapper, infer) for p in pages]


@pytest.mark.parametrize("page", [
    '<html><body class="single no-sidebar"><article><h1>Title {1}</h1><p>{0}</p></article></body></html>',
    '<body><article class="post type-post category-social tag-search"><h1>Title {1}</h1><p>{0}</p></article></body>',
    '<body><div class="page has-header"><main><h1>Title {1}</h1><p>{0}</p></main></div></body>',
    '<body><div id="main-widget-area"><article><h1>Title {1}</h1><p>{0}</p></article></div></body>',
    '<html class="no-js hidden-xs"><body><h1>Title {1}</h1><p>{0}</p></body></html>',
    '<body><form id="aspnet"><article><h1>Title {1}</h1><p>{0}</p></article></form></body>',
    '<body class="has-popup"><div class="overlay search-page"><h1>Title {1}</h1><p>{0}</p></div><div class="ad">Buy</div></body>',
    '<body><div style="display: none"><article><h1>Title {1}</h1><p>{0}</p></article></div></body>',
    '<body aria-hidden="true"><article><h1>Title {1}</h1><p>{0}</p><p hidden>Not seen {1}</p><span><p style="display:none">Nor this {1}</p></span></article></body>',
    '<body><article><h2 class="search-result-title">Title {1}</h2><p class="legal">{0}</p></article></body>',
    '<body><article><h1>Title {1}</h1><p>{0}</p></article><ol class="comments"><li><article class="comment">I say</article></ol></body>',
])
@pytest.mark.parametrize("n", [1, 6])
def test_names_are_a_prior(page, n):
    stories = [STORY.format(f"number {i}").strip() for i in range(n)]
    assert texts_of([page.format(s, i) for i, s in enumerate(stories)]) == [f"Title {i} {s}" for i, s in enumerate(stories)]


def unmarked(i):
    """A host without any telling tag or name: a template, links, a varying box beside the article, and the article in paragraphs."""
    rng = random.Random(i)
    story = [" ".join(rng.choice("lorem ipsum dolor sit amet elit sed do".split()) for _ in range(40)) + f" {i}." for _ in range(3 + i % 4)]
    links = "".join(f"<div><a href=/{k}>Go to page {rng.randrange(99)}</a></div>" for k in range(5))
    page = f"<body><div class=q>Home of all pages</div><div class=z>{links}</div><div class=x><h1>Story {i}</h1><div class=k>{''.join(f'<p>{p}</p>' for p in story)}</div>" \
           f"</div><div class=r>Weather today: {rng.randrange(40)} degrees</div><div class=e>All rights are ours</div></body>"
    return page, " ".join([f"Story {i}", *story])


def test_slots_select_the_article():
    pages, want = zip(*map(unmarked, range(12)))
    assert texts_of(pages) == list(want)
    off = texts_of(pages, infer=False)
    assert all(a != b and "Home of all pages" in a and "degrees" in a for a, b in zip(off, want))


def test_fixed_boxes_of_a_marked_article():
    pages = [f"<article><h1>Title</h1><p>{STORY.format(i)}</p><div class=zz><p>Read us every day</p></div><p>End</p></article>" for i in range(5)]
    assert texts_of(pages) == [f"Title {STORY.format(i)}End" for i in range(5)]
    assert texts_of(pages, infer=False) == [f"Title {STORY.format(i)}Read us every day End" for i in range(5)]
    assert texts_of(pages[:2]) == [f"Title {STORY.format(i)}Read us every day End" for i in range(2)]  # too few pages to tell


def test_wide_pages_are_read_in_linear_time():
    def wide(seed):
        letters = random.Random(seed)
        return "<body><article>" + "".join(f'<div class="{"".join(letters.choices("abcdefgh", k=6))}">t{i}</div>' for i in range(20_000)) + "</article></body>"
    began = time.perf_counter()
    got = texts_of([wide(1), wide(2), wide(3)])
    assert got == [" ".join(f"t{i}" for i in range(20_000))] * 3 and time.perf_counter() - began < 30


def test_wrapper_does_not_grow_with_templates():
    rng = random.Random(4)

    def page(i):
        return '<body><div class="top">Home</div><div class="content">' + "".join(f'<div class="{"".join(rng.choices("abcdefghij", k=8))}">text {i} {k}</div>' for k in range(20)) + "</div></body>"
    began, wrapper, sizes = time.perf_counter(), None, []
    for i in range(3000):
        own = wrappers.wrapper_of(wrappers.parse(page(i)))
        wrapper = own if wrapper is None else wrappers.joined(wrapper, own)
        if i in (299, 2999):
            sizes.append(len(json.dumps(wrapper)))
    assert time.perf_counter() - began < 30 and sizes[1] < 1.2 * sizes[0] < 60_000
    assert wrappers.extract(page(7), json.dumps(wrapper)) == " ".join(f"text 7 {k}" for k in range(20))


@pytest.mark.parametrize("few", [0, 100])
def test_large_hosts_in_stretches(spark, monkeypatch, few):
    monkeypatch.setattr(wrappers, "STRETCH", 4)
    monkeypatch.setattr(wrappers, "FEW_HOSTS", few)
    pages, want = zip(*map(unmarked, range(30)))
    rows = [(i, f"http://h{i % 7 // 5}.example/{i}", p) for i, p in enumerate(pages)] + [(99, "http://h0.example/", None), (98, "http://other.example/", "")]
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert [got[i] for i in range(30)] == list(want) and got[99] == got[98] == "" and len(got) == 32
