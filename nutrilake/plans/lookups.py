"""Lookup queries over the whole question and product tables: barcode
lookup, name search, SQL-style search, reference resolution, question
resolution, additive sheets and mining, products without a country and
country completion from the product reference source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nutrilake.functions import missing
from nutrilake.functions import questions as Q
from nutrilake.operators import keywords, lookup, regexsearch
from nutrilake.sources import tables

SEARCH_LIMIT = 5


def questions_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = tables.questions(spark, sf_dir)
    return q.select(
        "*",
        Q.detect_intent(F.col("question")).alias("intention"),
        Q.extract_barcode(F.col("question"), F.col("codebarres")).alias("codebarres_effectif"),
        lookup.additive_code(F.col("question")).alias("code_additif"),
        Q.deduced_reference(F.col("question"), F.col("indice_produit"), F.col("codebarres"))
        .alias("reference_deduite"),
        Q.quoted_texts(F.col("question")).alias("textes_guillemets"),
    )


def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions_enriched(spark, sf_dir)
    return q.select("q_id", "intention", "codebarres_effectif", "code_additif", "reference_deduite",
                    F.size("textes_guillemets").cast("bigint").alias("n_guillemets"),
                    F.get(F.col("textes_guillemets"), 0).alias("premier_guillemet"))


def _products(spark, sf_dir):
    return tables.products(spark, sf_dir)


def barcode_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with a barcode -> first product with that code."""
    q = tables.questions(spark, sf_dir)
    p = _products(spark, sf_dir).select("row_id", "code", "product_name")
    return lookup.barcode_lookup(q, "q_id", "codebarres", p).select("q_id", "codebarres", "row_id",
                                                                    "product_name")


def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with a product hint -> first 5 products whose name
    contains the (trimmed) hint, case-insensitively, in file order."""
    q = tables.questions(spark, sf_dir).select("q_id", F.trim("indice_produit").alias("hint")) \
        .where(F.col("hint") != "")
    p = _products(spark, sf_dir).select("row_id", "product_name")
    m = lookup.substring_matches(q, "q_id", "hint", p, "row_id", "product_name", SEARCH_LIMIT)
    return m.join(p, "row_id").select("q_id", "pos", "row_id", "product_name")


#: Fields of the keyword search and the points of a word found in each.
SEARCH_FIELDS = {"code": 8, "product_name": 4, "categories": 2, "countries": 1, "nutriscore_grade": 1}


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each question and its hint, searched in five fields of the product reference source; a page of 5."""
    q = tables.questions(spark, sf_dir).select("q_id", F.concat_ws(" ", "question", "indice_produit").alias("terms"))
    ext = tables.external_products(spark, sf_dir).select("code", "product_name", "countries", "categories",
                                                         F.col("nutrition_grades").alias("nutriscore_grade"))
    found = keywords.keyword_search(q, "q_id", "terms", ext, "code", SEARCH_FIELDS, SEARCH_LIMIT)
    return found.join(ext, "code").select("q_id", "pos", "n_words", "points", *ext.columns)


def hint_pattern(hint: Column) -> Column:
    """A pattern over the words of a hint: two of them in order, either of two before a third, one at the start,
    one with any vowel in it, one letter optional; every eighth kind is the hint itself."""
    word = F.split(hint, " ")

    def w(i: int) -> Column:
        return F.coalesce(F.get(word, F.lit(i)), F.lit("zz"))
    kinds = [F.concat(w(0), F.lit(".*"), w(2)), F.concat(F.lit("("), w(0), F.lit("|"), w(1), F.lit(") "), w(2)), F.concat(F.lit("^"), w(1), F.lit(r"\b")),
             F.concat(F.substring(w(0), 1, 2), F.lit("[aeiou]."), F.lit("*"), w(3)), F.concat(w(0), F.lit("s? "), F.lit("[a-m]")),
             F.concat(w(1), F.lit("( [a-z]+){2}$")), F.concat(F.lit("(?:"), w(0), F.lit(" )?"), w(1), F.lit(".+"), w(2))]
    return F.coalesce(F.get(F.array(*kinds), F.pmod(F.length(hint), F.lit(len(kinds) + 1))), hint)


def name_regex_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern over the words of each question's hint -> first 5 products whose name it matches, in file order."""
    q = tables.questions(spark, sf_dir).select("q_id", F.trim("indice_produit").alias("hint")).where(F.col("hint") != "") \
        .select("q_id", hint_pattern(F.col("hint")).alias("pattern"))
    p = _products(spark, sf_dir).select("row_id", "product_name")
    m = regexsearch.regex_matches(q, "q_id", "pattern", p, "row_id", "product_name", SEARCH_LIMIT)
    return m.join(p, "row_id").join(q, "q_id").select("q_id", "pattern", "pos", "row_id", "product_name")


def sql_candidates(q: DataFrame, p: DataFrame, n: int = SEARCH_LIMIT) -> DataFrame:
    """P10 in bulk: ``trim(code) = v OR lower(name) LIKE lower('%v%')``,
    first n in file order. ``q`` has (q_id, ref) with ref trimmed, non-empty.

    The first n of the union are among the first n code matches and the
    first n name matches, so each side is cut to n per request before the
    union (the code side per code, partially before its shuffle)."""
    wc = Window.partitionBy("ref").orderBy("row_id")
    code_rows = (p.select("row_id", F.trim("code").alias("ref")).where(F.col("ref").isNotNull())
                 .withColumn("_r", F.row_number().over(wc)).where(F.col("_r") <= n))
    by_code = q.join(code_rows, "ref").select("q_id", "row_id")
    by_name = lookup.substring_matches(q, "q_id", "ref", p, "row_id", "product_name", n, like=True) \
        .select("q_id", "row_id")
    w = Window.partitionBy("q_id").orderBy("row_id")
    both = by_code.unionByName(by_name).distinct()
    return both.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def sql_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions_enriched(spark, sf_dir).select("q_id", F.col("reference_deduite").alias("ref")) \
        .where(F.col("ref") != "")
    p = _products(spark, sf_dir).select("row_id", "code", "product_name")
    c = sql_candidates(q, p)
    return c.join(p, "row_id").select("q_id", "pos", "row_id", "code", "product_name")


def resolve_reference_df(refs: DataFrame, p: DataFrame) -> DataFrame:
    """(q_id, ref) -> product row_id: code match first, else first name match."""
    by_code = lookup.barcode_lookup(refs, "q_id", "ref", p.select("row_id", "code")) \
        .select("q_id", F.col("row_id").alias("code_row"))
    by_name = lookup.substring_matches(refs, "q_id", "ref", p, "row_id", "product_name", 1) \
        .select("q_id", F.col("row_id").alias("name_row"))
    return (refs.join(by_code, "q_id", "left").join(by_name, "q_id", "left")
            .select("q_id", "ref", F.coalesce("code_row", "name_row").alias("row_id"),
                    F.when(F.col("code_row").isNotNull(), F.lit("code"))
                    .when(F.col("name_row").isNotNull(), F.lit("nom")).alias("via")))


def resolve_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions_enriched(spark, sf_dir).select("q_id", F.col("reference_deduite").alias("ref")) \
        .where(F.col("ref") != "")
    p = _products(spark, sf_dir).select("row_id", "code", "product_name")
    r = resolve_reference_df(q, p)
    return r.join(p, "row_id", "left").select("q_id", "ref", "via", "row_id", "code", "product_name")


def resolve_question_df(q: DataFrame, p: DataFrame) -> DataFrame:
    """Barcode (given or in the text) -> hint name -> each quoted text in
    order -> none. Candidates are ranked by (priority, quote position) and
    the best one kept per question."""
    bc = q.select("q_id", F.col("codebarres_effectif").alias("ref"))
    by_code = lookup.barcode_lookup(bc, "q_id", "ref", p.select("row_id", "code")) \
        .where(F.col("row_id").isNotNull()).select("q_id", F.lit(0).alias("prio"), F.lit(0).alias("qpos"),
                                                   "row_id")
    names = q.select("q_id", F.lit(1).alias("prio"), F.lit(0).alias("qpos"),
                     F.trim("indice_produit").alias("needle")) \
        .unionByName(q.select("q_id", F.lit(2).alias("prio"),
                              F.posexplode("textes_guillemets").alias("qpos", "needle"))) \
        .where(F.col("needle").isNotNull() & (F.col("needle") != ""))
    names = names.withColumn("needle", F.trim("needle")).where(F.col("needle") != "") \
        .withColumn("nid", F.concat_ws(":", "q_id", "prio", "qpos"))
    m = lookup.substring_matches(names, "nid", "needle", p, "row_id", "product_name", 1)
    by_name = names.join(m, "nid").select("q_id", "prio", "qpos", "row_id")
    cands = by_code.unionByName(by_name)
    best = cands.groupBy("q_id").agg(F.min(F.struct("prio", "qpos", "row_id")).alias("b"))
    return best.select("q_id", F.col("b.row_id").alias("row_id"),
                       F.element_at(F.array(F.lit("code"), F.lit("indice"), F.lit("guillemets")),
                                    F.col("b.prio") + 1).alias("via"))


def resolve_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions_enriched(spark, sf_dir)
    p = _products(spark, sf_dir).select("row_id", "code", "product_name")
    r = resolve_question_df(q, p)
    return (q.select("q_id").join(r, "q_id", "left").join(p, "row_id", "left")
            .select("q_id", "via", "row_id", "code", "product_name"))


def additive_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question naming an additive code -> its sheet and sentence."""
    q = questions_enriched(spark, sf_dir).where(F.col("code_additif").isNotNull()) \
        .select("q_id", "code_additif")
    return lookup.explain_additive(q, "code_additif", tables.additives(spark))


def additive_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive codes found in ingredient lists: products per code, with the sheet."""
    p = _products(spark, sf_dir).select("row_id", F.explode(F.array_distinct(
        lookup.additive_codes_all(F.col("ingredients_text")))).alias("code_additif"))
    counts = p.groupBy("code_additif").agg(F.count(F.lit(1)).alias("n_products"))
    return lookup.explain_additive(counts, "code_additif", tables.additives(spark)) \
        .select("code_additif", "n_products", "nom", "role", "url_source")


def missing_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose country is null, blank or nan/null/none."""
    p = _products(spark, sf_dir)
    return p.where(missing.is_missing_word(F.col("countries_en"))) \
        .select("row_id", "code", "product_name", "countries_en")


def country_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11: products without a country -> product reference source by code ->
    country text (countries, else tags, else none) -> filled column."""
    todo = missing_country(spark, sf_dir)
    ext = tables.external_by_code(spark, sf_dir).select(
        F.col("code").alias("_ecode"), "countries", "countries_tags")
    j = todo.join(ext, F.trim(F.col("code")) == F.col("_ecode"), "left")
    text = lookup.country_text(F.col("countries"), F.col("countries_tags"))
    found = F.col("_ecode").isNotNull()
    pays = F.when(found & (text != ""), text)
    return j.select(
        "row_id", "code", "product_name", "countries_en",
        F.coalesce(pays, F.lit("information non trouvee")).alias("pays"),
        F.when(pays.isNotNull(), pays).otherwise(F.col("countries_en")).alias("countries_completed"),
        F.when(~found, F.lit("Produit introuvable")).alias("erreur"),
    )
