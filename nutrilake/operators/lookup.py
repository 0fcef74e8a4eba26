"""Product lookups in bulk form.

Single-product lookups of the reference (one barcode, one name) become
joins between a table of requests and the product table:

* barcode lookups are equi-joins on the trimmed code against one row per
  code (the first in file order, pre-aggregated map-side);
* name searches (case-insensitive containment, or SQL LIKE with ``%``/``_``)
  are theta-joins. They run as an n-gram equi-join: every distinct needle
  picks its rarest gram, joins the gram postings of the haystack, verifies
  the real predicate on the candidates and keeps the first ``n`` matches by
  ``row_id``. A needle is only compared with texts that share its rarest
  gram, never with the whole table, and the per-needle top-n is a window
  group limit that Spark applies partially before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, size: Column | int) -> Column:
    """Distinct substrings of ``size`` characters of ``text``."""
    n = F.length(text)
    size_c = size if isinstance(size, Column) else F.lit(size)
    idx = F.sequence(F.lit(1), F.greatest(n - size_c + 1, F.lit(1)))
    return F.array_distinct(F.transform(idx, lambda i: F.substring(text, i, size_c)))


def gram_index(haystack: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, key, ltext) postings for grams of 1..3 characters of lower(text)."""
    low = haystack.select(F.col(key).alias("_key"), F.lower(F.col(text)).alias("ltext")) \
        .where(F.col("ltext").isNotNull() & (F.length("ltext") > 0))
    grams = F.array_distinct(F.flatten(F.array(*[
        F.when(F.length("ltext") >= g, _grams(F.col("ltext"), g)).otherwise(F.array().cast("array<string>"))
        for g in range(1, GRAM + 1)])))
    return low.select(F.explode(grams).alias("gram"), "_key", "ltext")


def _needle_grams(pattern: Column, like: bool) -> Column:
    """Grams a match must contain: from the literal pieces of the pattern
    (split on the LIKE wildcards when ``like``), all of one size
    ``min(3, longest piece)``."""
    pieces = F.split(pattern, "[%_]") if like else F.array(pattern)
    longest = F.array_max(F.transform(pieces, lambda p: F.length(p)))
    size = F.least(F.lit(GRAM), longest)
    grams = F.array_distinct(F.flatten(F.transform(
        F.filter(pieces, lambda p: F.length(p) >= size),
        lambda p: _grams(p, size))))
    # no literal character at all (only wildcards): no gram, every text matches
    return F.when(longest > 0, grams).otherwise(F.array().cast("array<string>"))


def like_to_regex(pattern: Column) -> Column:
    """SQL LIKE pattern (no escape char) -> anchored Java regex."""
    quoted = F.concat(F.lit("\\Q"), F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    re_ = F.replace(F.replace(quoted, F.lit("%"), F.lit("\\E.*\\Q")), F.lit("_"), F.lit("\\E.\\Q"))
    return F.concat(F.lit("(?s)^"), re_, F.lit("$"))


def substring_matches(needles: DataFrame, needle_id: str, needle: str, haystack: DataFrame, key: str,
                      text: str, n: int, like: bool = False) -> DataFrame:
    """First ``n`` haystack rows (by ``key``) whose text contains the needle,
    case-insensitively (``like=False``), or matches ``lower(text) LIKE
    lower('%' || needle || '%')`` (``like=True``).

    Returns (needle_id, key, pos) with pos = 1..n.
    """
    pats = needles.select(needle_id, F.lower(F.col(needle)).alias("pat")).where(F.col("pat").isNotNull())
    distinct_pats = pats.select("pat").distinct()
    index = gram_index(haystack, key, text)
    freq = index.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    pg = distinct_pats.select("pat", F.explode_outer(_needle_grams(F.col("pat"), like)).alias("gram"))
    rarest = (pg.join(freq, "gram", "left")
              .groupBy("pat")
              .agg(F.min_by(F.col("gram"), F.struct(F.coalesce(F.col("df"), F.lit(0)), F.col("gram")))
                   .alias("gram")))
    with_gram = rarest.where(F.col("gram").isNotNull())
    cand = with_gram.join(index, "gram")
    if like:
        ok = F.regexp_like(F.col("ltext"), like_to_regex(F.concat(F.lit("%"), F.col("pat"), F.lit("%"))))
    else:
        ok = F.instr(F.col("ltext"), F.col("pat")) > 0
    hits = cand.where(ok).select("pat", "_key")
    if like:
        # a pattern made only of wildcards matches every non-empty text
        # (n rows at most: a bounded broadcast on a constant key)
        every = rarest.where(F.col("gram").isNull()).select("pat", F.lit(1).alias("_all"))
        first_n = (haystack.where(F.col(text).isNotNull() & (F.length(F.col(text)) > 0))
                   .select(F.col(key).alias("_key")).orderBy("_key").limit(n))
        hits = hits.unionByName(every.join(F.broadcast(first_n.withColumn("_all", F.lit(1))), "_all")
                                .select("pat", "_key"))
    w = Window.partitionBy("pat").orderBy("_key")
    top = hits.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
    return (pats.join(top, "pat")
            .select(F.col(needle_id), F.col("_key").alias(key), F.col("pos")))


def first_by_code(products: DataFrame, code: str = "code", key: str = "row_id") -> DataFrame:
    """One row per trimmed code: the first product in file order. The
    min_by aggregate is partial, so a code held by many rows collapses map-side."""
    cols = [c for c in products.columns if c != key]
    return (products.where(F.col(code).isNotNull())
            .groupBy(F.trim(F.col(code).cast("string")).alias("_code"))
            .agg(F.min_by(F.struct(F.col(key), *[F.col(c) for c in cols]), F.col(key)).alias("p"))
            .select("_code", "p.*"))


def barcode_lookup(requests: DataFrame, req_id: str, barcode: str, products: DataFrame,
                   key: str = "row_id") -> DataFrame:
    """Each request -> first product whose trimmed code equals the
    trimmed barcode (blank -> no match). Left join: unmatched keep nulls."""
    reqs = requests.select(req_id, barcode, F.trim(F.col(barcode)).alias("_code"))
    reqs = reqs.where(F.col("_code").isNotNull() & (F.col("_code") != ""))
    prods = first_by_code(products, key=key)
    return reqs.join(prods, "_code", "left").drop("_code")


def additive_code(text: Column) -> Column:
    """first additive code in the upper-cased text, as ``E`` + digits.
    Upper-casing means a letter suffix never matches (``e150a`` -> null)."""
    m = F.regexp_extract(F.upper(text), r"\bE\s?([0-9]{3,4}[a-z]?)\b", 1)
    return F.when(m != "", F.concat(F.lit("E"), F.upper(m)))


def additive_codes_all(text: Column) -> Column:
    """All additive codes of a text (bulk mining of ingredient lists)."""
    ms = F.regexp_extract_all(F.upper(text), F.lit(r"\bE\s?([0-9]{3,4}[a-z]?)\b"), 1)
    return F.transform(ms, lambda m: F.concat(F.lit("E"), F.upper(m)))


def explain_additive(df: DataFrame, code_col: str, additives: DataFrame) -> DataFrame:
    """J8 + F6 + F7: join the (7-row, fixed) dictionary; unknown codes get the
    default sheet with a search URL; ``phrase`` is the one-line explanation."""
    d = F.broadcast(additives.select(F.col("code").alias("_acode"),
                                     *[F.col(c).alias("_a_" + c) for c in
                                       ("nom", "role", "description", "source_nom", "url_source")]))
    j = df.join(d, F.col(code_col) == F.col("_acode"), "left")
    known = F.col("_acode").isNotNull()
    nom = F.when(known, F.col("_a_nom")).otherwise(F.lit("Additif non repertorie localement"))
    role = F.when(known, F.col("_a_role")).otherwise(F.lit("inconnu"))
    desc = F.when(known, F.col("_a_description")).otherwise(
        F.lit("Aucune fiche locale n'est disponible. Une verification externe est necessaire."))
    src = F.when(known, F.col("_a_source_nom")).otherwise(F.lit("Open Food Facts"))
    url = F.when(known, F.col("_a_url_source")).otherwise(
        F.concat(F.lit("https://fr.openfoodfacts.org/recherche?search_terms="), F.col(code_col)))
    out = j.select(*df.columns, nom.alias("nom"), role.alias("role"), desc.alias("description"),
                   src.alias("source_nom"), url.alias("url_source"))
    return out.withColumn("phrase", F.concat(
        F.col(code_col), F.lit(" - "), F.col("nom"), F.lit(" ("), F.col("role"), F.lit(") : "),
        F.col("description"), F.lit(" Source : "), F.col("source_nom"), F.lit(" - "), F.col("url_source")))


def country_text(countries: Column, countries_tags: Column) -> Column:
    """``countries`` if non-empty, else the tags joined by ", ", else ""."""
    tags = F.when(F.size(countries_tags) > 0, F.array_join(countries_tags, ", "))
    return F.coalesce(F.when(countries != "", countries), tags, F.lit(""))
