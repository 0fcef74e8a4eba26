"""t1: unit tests on hand-written rows, with the reference's quirks as golden cases."""

import math

import pytest
from pyspark.sql import functions as F

from nutrilake.functions import missing, nutrition as N, questions as Q
from nutrilake.functions.rules import ok_diff, rule_engine
from nutrilake.operators import clean, lookup, memory, profile, sampling, textsim


def one(spark, expr, schema, rows):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr.alias("x")).collect()]


def test_score_to_grade_boundaries(spark):
    got = one(spark, N.score_to_grade(F.col("s")), "s double",
              [(-1.0,), (-0.5,), (2.0,), (2.5,), (10.0,), (10.5,), (18.0,), (18.5,), (None,), (float("nan"),)])
    assert got == ["a", "b", "b", "c", "c", "d", "d", "e", None, "e"]


def test_missing_notions(spark):
    rows = [(None,), ("",), (" ",), ("nan",), ("NaN",), ("null",), ("None",), ("none",), ("x",)]
    assert one(spark, missing.is_blank(F.col("v")), "v string", rows) == [True, True, True, False, False, False,
                                                                          False, False, False]
    assert one(spark, missing.is_missing_word(F.col("v")), "v string", rows) == [True, True, True, True, True,
                                                                                 True, True, True, False]
    # notion 4: exact spellings only, no trim, nan is a value
    assert one(spark, missing.is_missing_exact(F.col("v")), "v string", rows) == [True, True, False, False, False,
                                                                                  True, True, False, False]


def test_first_number_reads_nan_text_as_nan(spark):
    got = one(spark, missing.first_number(F.col("a"), F.col("b")), "a string, b string",
              [("null", "3.5"), ("nan", "1"), ("", None), ("abc", "2")])
    assert got[0] == 3.5 and math.isnan(got[1]) and got[2] is None and got[3] == 2.0


def test_zero_is_missing_quirk(spark):
    # a flat 0.0 falls back to the nutriments map, and to null if absent there
    df = spark.createDataFrame([(0.0, {"sugars_100g": 7.0}), (0.0, {}), (5.0, {"sugars_100g": 7.0})],
                               "s double, m map<string,double>")
    norm = N.add_normalized(df, {"sugars_100g": F.col("s")}, F.col("m"))
    assert [r[0] for r in norm.select("_n_sugars_100g").collect()] == [7.0, None, 5.0]
    sane = N.add_normalized(df, {"sugars_100g": F.col("s")}, F.col("m"), zero_is_missing=False)
    assert [r[0] for r in sane.select("_n_sugars_100g").collect()] == [0.0, 0.0, 5.0]


def test_heuristic_estimate(spark):
    df = spark.createDataFrame([(None, 45.0, 10.0, 1.5, 7.0, 8.0), (None, None, None, None, None, None),
                                (-3, 50.0, None, None, None, None)],
                               "score int, sug double, sat double, salt double, fib double, pro double")
    flat = {"nutrition-score-fr_100g": F.col("score"), "sugars_100g": F.col("sug"),
            "saturated-fat_100g": F.col("sat"), "salt_100g": F.col("salt"), "fiber_100g": F.col("fib"),
            "proteins_100g": F.col("pro")}
    r = N.add_estimate(N.add_normalized(df, flat)).collect()
    assert r[0]._e_score_estime == 10 + 10 + 8 - 5 - 2 and r[0]._e_grade_estime == "e"  # 21 > 18
    assert r[1]._e_grade_estime == "b" and r[1]._e_justification.endswith(": . Score estime = 0.0.")
    assert r[2]._e_methode == "score_officiel_present" and r[2]._e_grade_estime == "a"


def test_scan_points_thresholds(spark):
    df = spark.createDataFrame([({"energy-kj_100g": 335.0, "sugars_100g": 4.5},),
                                ({"energy-kj_100g": 335.1, "sugars_100g": 4.6},),
                                ({"energy-kj_100g": 3351.0, "sugars_100g": 46.0, "saturated-fat_100g": 11.0,
                                  "salt_100g": 3.0, "proteins_100g": 9.0},)], "m map<string,double>")
    r = N.add_scan_score(df, F.col("m")).collect()
    assert r[0]._s_score_numerique == 0 and r[1]._s_score_numerique == 2
    # N = 40 >= 11 and few fruits: proteins do not count
    assert r[2]._s_score_numerique == 40 and r[2]._s_nutriscore_predit == "E"


def test_row_filter_null_safe(spark):
    df = spark.createDataFrame(
        [("a", "b", "c", 1, None, 0.1, 0.1), ("a", "b", "c", 1, 101.0, 0.1, 0.1), ("a", "b", "c", 1, 5.0, 0.1, 100.0),
         (None, "b", "c", 1, 5.0, 0.1, 0.1), ("a", "b", "c", 1, -0.5, 0.1, 0.1)],
        "product_name string, brands_tags string, categories_en string, nutrition_score_fr_100g int, "
        "sugars_100g double, salt_100g double, sodium_100g double")
    kept = clean.row_filter_non_matching(df).collect()
    assert len(kept) == 1 and kept[0].sugars_100g is None


def test_expand_by_dimension_suffix(spark):
    df = spark.createDataFrame([(1, "x")], "row_id int, Temps string")
    out = clean.expand_by_dimension(df, [("A", "1"), ("B", "2")], ["Distributeur", "Temps"])
    assert out.columns == ["row_id", "Temps", "Distributeur", "Temps (#1)"] and out.count() == 2


def test_additive_code_quirks(spark):
    got = one(spark, lookup.additive_code(F.col("t")), "t string",
              [("Explique l’additif E330",), ("e150a est-il sain ?",), ("E 322 : quel role ?",), ("Bonjour",),
               ("contient e471",)])
    assert got == ["E330", None, "E322", None, "E471"]


def test_intent_and_barcode(spark):
    df = spark.createDataFrame([("Trouve des produits similaires", None), ("Le pays de 12345678 ?", None),
                                ("Ce Nutri-Score est-il cohérent ?", " 987 "), ("Bonjour", None)],
                               "q string, b string")
    r = df.select(Q.detect_intent(F.col("q")), Q.extract_barcode(F.col("q"), F.col("b"))).collect()
    assert [x[0] for x in r] == ["similarite", "origine", "coherence", "rag"]
    assert [x[1] for x in r] == [None, "12345678", "987", None]


def test_rules(spark):
    got = one(spark, ok_diff(F.col("a"), F.col("b")), "a string, b string", [("a", "a"), ("a", "b"), (None, "a")])
    assert got == ["OK", "DIFF", "DIFF"]
    got = one(spark, rule_engine([("x > 1", "big"), (F.col("x") > 0, "small")], "none"), "x int", [(2,), (1,), (0,)])
    assert got == ["big", "small", "none"]


def test_like_to_regex_and_substring_matches(spark):
    hay = spark.createDataFrame([(1, "Chili Mango"), (2, "mango chutney"), (3, "Tea"), (4, None), (5, "50%_off")],
                                "row_id long, name string")
    needles = spark.createDataFrame([(10, "mango"), (11, "CHILI"), (12, "t"), (13, "%"), (14, "0%_")],
                                    "q long, n string")
    got = {(r.q, r.row_id) for r in lookup.substring_matches(needles, "q", "n", hay, "row_id", "name", 5,
                                                             like=True).collect()}
    assert {(10, 1), (10, 2), (11, 1)} <= got
    assert {(12, 2), (12, 3)} <= got and (12, 5) not in got   # 't' in chutney and Tea only
    assert (13, 4) not in got and (13, 1) in got    # a pattern of wildcards matches every non-empty text
    assert (14, 5) in got


def test_exact_sample_and_split(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    s = sampling.exact_sample(df, "k", 123)
    assert s.count() == 123
    assert sampling.exact_sample(df, "k", 5000).count() == 1000
    sp = sampling.split_relative(df, "k", 0.8)
    counts = {r.partition: r["count"] for r in sp.groupBy("partition").count().collect()}
    assert counts == {"train": 800, "test": 200}
    with pytest.raises(Exception):
        sampling.split_relative(df.where("k < 0"), "k").collect()


def test_recent_context(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "z")], "c long, t long, x string")
    out = {(r.c, r.t): r.contexte for r in memory.recent_context(df, "c", "t", F.col("x"), 5).collect()}
    assert out[(1, 0)] == memory.NO_HISTORY and out[(1, 2)] == "1. a\n2. b" and out[(2, 0)] == memory.NO_HISTORY


def test_pair_similarity(spark):
    got = one(spark, textsim.pair_similarity(F.col("a"), F.col("b")), "a string, b string",
              [("red apple", "red apple"), ("red apple", "green pear"), ("", ""), ("a", "b")])
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] is None and got[3] is None


def test_sources_helpers(spark):
    from nutrilake.sources import files
    df = spark.createDataFrame([(2, None, None), (1, "x", 1.0), (3, "y", None)], "row_id long, s string, d double")
    assert [r.row_id for r in files.bounded_scan(df, 2).collect()] == [1, 2]
    assert files.bounded_scan(df).count() == 3
    filled = {r.row_id: (r.s, r.d) for r in files.fill_missing_text(df).collect()}
    assert filled[2] == ("", None) and filled[3] == ("y", None)


def test_recent_context_with_gaps(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 10, "b"), (1, 20, "c"), (1, 21, "d"), (2, 5, "z")], "c long, t long, x string")
    out = {(r.c, r.t): r.contexte for r in memory.recent_context(df, "c", "t", F.col("x"), 2).collect()}
    assert out[(1, 10)] == "1. a" and out[(1, 20)] == "1. a\n2. b" and out[(1, 21)] == "1. b\n2. c"
    assert out[(1, 1)] == out[(2, 5)] == memory.NO_HISTORY


def test_sample_with_repeated_keys(spark):
    df = spark.createDataFrame([(k,) for k in (1, 1, 1, 2, 2, 3)], "k long")
    assert [sampling.exact_sample(df, "k", n).count() for n in range(8)] == [0, 1, 2, 3, 4, 5, 6, 6]
    assert sampling.split_relative(df, "k", 0.5).count() == 6


def test_csv_sink_round_trip(spark, tmp_path):
    from nutrilake.sources import files
    df = spark.range(1000).selectExpr("id", "concat('a \"q\", ', id) as s", "id / 8 as d").repartition(8)
    files.write_csv_strings_quoted(df, str(tmp_path / "out"))
    back = spark.read.schema(df.schema).option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.count() == 1000 and back.exceptAll(df).isEmpty()
    files.write_csv_strings_quoted(df.limit(0), str(tmp_path / "none"))
    assert spark.read.option("header", True).csv(str(tmp_path / "none")).columns == ["id", "s", "d"]


def test_tsv_scan_leaves_the_session_alone(spark, tmp_path):
    from nutrilake.sources import files
    before = spark.conf.get("spark.sql.csv.parser.columnPruning.enabled")
    (tmp_path / "a.tsv").write_text('a\tb\tc\n1\t2\t3\n1\t2\t3\t4\n5\t6\n7\n1\t2\t3\t4\t5\n"8\t8"\t"9\t"\n')
    got = files.read_reference_tsv(spark, str(tmp_path / "a.tsv"), ["a", "b", "c"], ["b", "c"])
    assert sorted((r.b or "", r.c or "") for r in got.collect()) == [("", ""), ("2", "3"), ("6", ""), ("9\t", "")]
    assert got.count() == 4
    assert spark.conf.get("spark.sql.csv.parser.columnPruning.enabled") == before


def test_quartiles_are_exact_in_large_columns(spark):
    # more different values than a sketch of 1/100000 holds exactly, a heavy one, and negative, fractional and missing ones
    n = 400_003
    df = spark.range(n).select(
        ((F.col("id") * 7919) % n - 1000).alias("a"),
        F.when(F.col("id") % 3 == 0, F.lit(0.1)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") / 9 - 5).alias("b"),
        F.lit(None).cast("double").alias("c"), F.lit("x").alias("d"))
    got = {r.column_name: (r.q25, r.q50, r.q75) for r in profile.column_profile(df).collect()}
    for c in ("a", "b"):
        values = sorted(r[0] for r in df.select(F.col(c).cast("double")).where(F.col(c).isNotNull()).collect())
        assert got[c] == tuple(round(values[-(-k * len(values) // 4) - 1], 6) for k in (1, 2, 3))
    assert got["c"] == got["d"] == (None, None, None)
