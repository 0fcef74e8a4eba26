"""The cascade's order: rejections per second given the rules before, and verdicts that do not depend on it."""

import time

import numpy as np

from nutrilake.llm import quality
from nutrilake.llm.textbytes import texts_of
from tests.conftest import SF_ORACLE
from tests.llm.test_llm import read


def slow(seconds):
    def wait(figures):
        time.sleep(seconds)
        return figures.n_words > 10**9
    return wait


def test_order_follows_rejections_per_second(spark):
    docs = read(spark, "documents", SF_ORACLE).select("doc_id", "text").repartition(2)
    rules = (quality.Rule("slow, rejects nothing", slow(0.5)), quality.Rule("rejects all, slowly", lambda f: slow(0.5)(f) | True),
             quality.Rule("rejects short ones", lambda f: f.n_words < 100), quality.Rule("the same", lambda f: f.n_words < 100))
    order = [r.name for r in quality.cascade_order(docs, rules)]
    # The second of two equal rules rejects nothing more, and the slow one that rejects all leaves nothing to the others.
    assert order[0] in ("rejects short ones", "the same") and order[1] == "rejects all, slowly"


def test_marginal_cost_of_shared_steps(spark):
    docs = read(spark, "documents", SF_ORACLE).select("doc_id", "text").repartition(2)
    masks, seconds = quality.marginal_costs(docs, sample_rows=10**6)
    names = [r.name for r in quality.RULES]
    repeated, few = names.index("repeated_words"), names.index("few_words")
    assert sum(masks.values()) == docs.count()
    assert seconds[repeated, few] < 0.2 * seconds[len(names), few]  # words are there after the windows
    _, later = quality.marginal_costs(docs, sample_rows=10**6, have=quality.BASE_FIGURES)
    assert later[len(names), repeated] < 0.2 * seconds[len(names), repeated]


def test_alive_rows_have_their_figures(spark):
    column = read(spark, "documents", SF_ORACLE).select("text").toArrow().column(0).combine_chunks()
    every = next(texts_of(column, 1 << 62))
    for rows in (np.arange(0, every.n, 9), np.arange(3, every.n), np.arange(1)):
        for name in ("n_words", "n_repeat_words", "n_dup_lines", "n_lines", "n_upper"):
            alive = quality.Alive(quality.Figures(every), column, 0, rows)
            assert (getattr(alive, name) == getattr(quality.Figures(every), name)[rows]).all()
