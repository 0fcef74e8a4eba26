"""t2: every registered query against its DuckDB oracle (row count, column
names, order-insensitive values); queries that SQL cannot express against
properties of their rows. A key with neither fails."""

import json
import math
import re
from collections import Counter

import pytest

import __spark_entry__ as E
from tests.conftest import SF_ORACLE
from tests.harness import compare, duck_connect

ORACLES = E.oracle_sql()
#: The training-data operators have tests of their own.
KEYS = sorted(k for k in E.queries() if not re.match(r"op\d|pipeline$", k))


def scored(rows):
    assert all(0.2 <= r.confidence <= 1 for r in rows)
    assert all(r.comparaison_nutri == ("OK" if r.nutrition_grade_fr == r.prediction else "DIFF") for r in rows)
    label = Counter(r.nutrition_grade_fr for r in rows)
    assert sum(r.nutrition_grade_fr == r.prediction for r in rows) > label.most_common(1)[0][1]


def n_products():
    return duck_connect(SF_ORACLE).execute("SELECT count(*) FROM part").fetchone()[0]


def holdout(rows):
    assert len(rows) == n_products() - math.floor(0.8 * n_products())
    scored(rows)


def full(rows):
    assert len(rows) == n_products()
    scored(rows)


def out_of_fold(rows):
    assert len({r.row_id for r in rows}) == len(rows) == n_products() and {r.fold for r in rows} == set(range(5))
    assert all(abs(sum(r[f"p_{g}"] for g in "abcde") - 1) < 1e-6 and r[f"p_{r.prediction}"] == max(r[f"p_{g}"] for g in "abcde") for r in rows)


def confusion(rows):
    assert sum(r[g] for r in rows for g in "abcde") == n_products() - math.floor(0.8 * n_products())


def class_scores(rows):
    n = n_products() - math.floor(0.8 * n_products())
    assert all(r.TP + r.FP + r.TN + r.FN == n for r in rows) and sum(r.TP + r.FN for r in rows) == n


def overall(rows):
    by = {r.rows: r for r in rows}
    assert by["full"].n_correct + by["full"].n_false == n_products() and by["full"].accuracy > by["holdout"].accuracy > 0.5
    assert 0 < by["holdout"].cohen_kappa < by["holdout"].accuracy


def importances(rows):
    assert len(rows) == 14 and abs(sum(r.importance for r in rows) - 1) < 1e-9


EVIDENCE = {
    "additif": {"additif"}, "categorie": {"categorie_suggeree", "categories_preuves", "produits_similaires", "candidats_ambigus"},
    "origine": {"origine", "exemples_sans_pays"}, "similarite": {"produits_similaires", "candidats_ambigus"},
    "coherence": {"coherence"}, "estimer_nutriscore": {"estimation"}, "rag": set(),
}


def answers(rows):
    assert len({r.q_id for r in rows}) == len(rows) == n_products()
    assert not any("None (Nutri-Score" in r.reponse or "Nutri-Score ?" in r.reponse for r in rows)
    for r in rows:
        payload = json.loads(r.charge_utile)
        part = payload["analyse"]
        assert payload["intention"] == r.intention and part["reponse"] in r.reponse
        told = {k for k, v in part.items() if v is not None} - {"reponse", "enrichissement", "justification"}
        assert told <= EVIDENCE[r.intention], (r.intention, told)
        if part["additif"]:
            assert part["reponse"].startswith(part["additif"]["code"] + " correspond a " + part["additif"]["nom"])
        if part["coherence"]:
            assert part["coherence"]["message"] == part["reponse"]
        if part["estimation"]:
            assert part["estimation"]["justification"] == part["justification"]
        if part["categorie_suggeree"]:
            assert part["categorie_suggeree"] in part["reponse"] and len(part["categories_preuves"]) <= 3
        sims = [x["similarite"] for x in part["produits_similaires"] or []]
        assert len(sims) <= 5 and sims == sorted(sims, reverse=True)


def imputed(rows):
    assert len(rows) == n_products()
    assert all(r.completed == (r.to_complete and r.score is not None and r.score >= 0.55) for r in rows)
    assert all(r.categories_en for r in rows if r.completed) and all(r.categories_en == "" for r in rows if r.to_complete and not r.completed)


def report(rows):
    assert len(rows) == 1 and 0 < rows[0].completed <= rows[0].to_complete
    assert abs(rows[0].pct_completed - 100 * rows[0].completed / rows[0].to_complete) < 1e-9


def out_of_bag(rows):
    n = math.floor(0.8 * n_products())
    assert len({r.row_id for r in rows}) == len(rows) == n
    assert all(abs(sum(r[f"p_{g}"] for g in "abcde") - 1) < 1e-9 and r[f"p_{r.prediction}"] == r.confidence == max(r[f"p_{g}"] for g in "abcde") for r in rows)
    # A bag of the full size lacks a row with probability 1/e.
    assert abs(sum(r.n_votes for r in rows) / (100 * n) - math.exp(-1)) < 0.01
    assert sum(r.nutrition_grade_fr == r.prediction for r in rows) > Counter(r.nutrition_grade_fr for r in rows).most_common(1)[0][1]


def responses(rows):
    assert len(rows) == n_products() and all(r.response and r.intent in EVIDENCE and r.question for r in rows)


def embedded(rows):
    assert len(rows) == n_products()
    assert all(len(r.vector) == 64 and abs(sum(x * x for x in r.vector) - bool(r.embedded)) < 1e-5 for r in rows)


def not_empty(rows):
    assert rows


PROPERTIES = {
    "forest_holdout": holdout, "forest_full": full, "out_of_fold": out_of_fold, "split_statistics": not_empty,
    "forest_confusion": confusion, "forest_class_scores": class_scores, "forest_overall": overall, "forest_ok_diff": not_empty,
    "forest_importances": importances, "gain_forest_holdout": holdout, "out_of_bag": out_of_bag, "api_responses": responses, "embed_model": embedded,
    "answers": answers, "impute_categories": imputed, "impute_categories_report": report,
}


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, key):
    if key in ORACLES:
        r = compare(spark, E.queries()[key], ORACLES[key], SF_ORACLE)
        assert r["cols_match"], r
        assert r["rows_match"], r
        assert r["values_match"], r
    else:
        PROPERTIES[key](E.queries()[key](spark, SF_ORACLE).collect())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns == ["Distributeur", "avg_nutrition_score"]
