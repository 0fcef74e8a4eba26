"""Nutrition functions (F8-F16, F12): product normalisation, score to grade,
heuristic grade estimate, coherence check and scan scoring.

All are built-in column expressions (codegen'd, no UDF). The multi-step ones
add their intermediate values as named columns, one projection per step:
a value used several times (a normalised nutrient, a score) is computed
once and referenced, instead of its definition being copied into every
use, which keeps the generated code small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nutrilake.functions.missing import first_number, first_value

# Grade order.
GRADES = ["a", "b", "c", "d", "e"]

# Score -> grade upper bounds (score <= bound), else "e".
GRADE_BOUNDS = [(-1, "a"), (2, "b"), (10, "c"), (18, "d")]

# Heuristic points (threshold reached with >=, points added).
HEURISTIC_SUGARS = [(45, 10), (31, 7), (18, 5), (9, 2)]
HEURISTIC_SAT_FAT = [(10, 10), (5, 7), (2, 4), (1, 2)]
HEURISTIC_SALT = [(1.5, 8), (1, 6), (0.6, 4), (0.3, 2)]
HEURISTIC_FIBER = [(7, -5), (4, -3), (2, -1)]
HEURISTIC_PROTEINS = [(8, -2), (4, -1)]

# Scan scoring points (threshold exceeded with >, points).
SCAN_ENERGY = [(3350, 10), (3015, 9), (2680, 8), (2345, 7), (2010, 6), (1675, 5), (1340, 4), (1005, 3),
               (670, 2), (335, 1)]
SCAN_SUGAR = [(45, 10), (36, 9), (27, 7), (18, 6), (9, 3), (4.5, 1)]
SCAN_SAT_FAT = [(10, 10), (8, 9), (6, 7), (4, 6), (2, 3), (1, 1)]
SCAN_SALT = [(2.3, 10), (1.5, 9), (0.9, 7), (0.6, 6), (0.3, 3), (0.15, 1)]
SCAN_FIBER = [(4.7, 5), (3.7, 4), (2.8, 3), (1.9, 2), (0.9, 1)]
SCAN_PROTEINS = [(8, 5), (6.4, 4), (4.8, 3), (3.2, 2), (1.6, 1)]
SCAN_FRUITS = [(80, 5), (60, 2), (40, 1)]


def grade_rank(grade: Column) -> Column:
    """F16: a..e -> 0..4, anything else -> null."""
    out = None
    for i, g in enumerate(GRADES):
        out = F.when(grade == g, F.lit(i)) if out is None else out.when(grade == g, F.lit(i))
    return out


def score_to_grade(score: Column) -> Column:
    """null -> null; NaN compares above every number, so it reaches "e"."""
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for bound, g in GRADE_BOUNDS:
        out = out.when(score <= bound, F.lit(g))
    return out.otherwise(F.lit("e"))


def _steps(x: Column, table: Sequence[tuple[float, int]], strict: bool) -> Column:
    # NaN compares above every number in Spark but fails every test in Python
    # A lookup in literal arrays: a chain of conditions a threshold outgrows the JVM's method limit.
    rising = sorted(table)
    bounds, points = F.array(*(F.lit(float(thr)) for thr, _ in rising)), F.array(F.lit(0), *(F.lit(pts) for _, pts in rising))
    passed = F.size(F.filter(bounds, lambda t: (x > t) if strict else (x >= t)))
    return F.when(F.isnan(x), F.lit(0)).otherwise(F.element_at(points, passed + 1))


NORM_FIELDS = ["product_name", "nutrition_grade_fr", "nutrition_score_fr", "sugars_100g", "saturated_fat_100g",
               "salt_100g", "fiber_100g", "proteins_100g", "fat_100g"]


def add_normalized(df: DataFrame, flat: dict[str, Column | None], nutriments: Column | None = None,
                   zero_is_missing: bool = True, prefix: str = "_n_") -> DataFrame:
    """the 9 normalised fields of a product as columns ``prefix + field``.

    ``flat`` maps reference keys to columns (absent keys -> None). A flat
    nutrient value falls back to ``nutriments[key]`` when it is missing or,
    with ``zero_is_missing`` (the reference's behaviour), when it is 0.0.
    Each field is its own projected column, so later expressions refer to
    it by name instead of repeating its definition.
    """
    present = {k: c for k, c in flat.items() if c is not None}
    kinds = dict(zip(present, (f.dataType for f in df.select(*[c.alias(f"_k{i}") for i, c in
                                                               enumerate(present.values())]).schema.fields)))

    def get(key: str) -> Column:
        c = flat.get(key)
        return F.lit(None).cast("string") if c is None else c

    def number(key: str) -> Column:
        # numbers are only missing when null; text follows notion 4 and must parse
        c = flat.get(key)
        if c is None:
            return F.lit(None).cast("double")
        if isinstance(kinds[key], T.NumericType):
            return c.cast("double")
        return first_number(c)

    def nutrient(flat_key: str) -> Column:
        v = number(flat_key)
        fallback = first_number(nutriments[flat_key]) if nutriments is not None else F.lit(None).cast("double")
        keep = v.isNotNull() & (v != 0) if zero_is_missing else v.isNotNull()
        # a 0.0 fallback stays 0.0 (x or y returns y)
        return F.when(keep, v).otherwise(fallback)

    grade = first_value(get("nutrition_grade_fr"), get("nutriscore_grade"), get("nutriscore"))
    score = F.coalesce(number("nutrition-score-fr_100g"), number("nutrition_score_fr"), number("nutriscore_score"))
    return df.withColumns({
        prefix + "product_name": first_value(get("product_name")),
        prefix + "nutrition_grade_fr": F.lower(F.coalesce(grade.cast("string"), F.lit(""))),
        prefix + "nutrition_score_fr": score,
        prefix + "sugars_100g": nutrient("sugars_100g"),
        prefix + "saturated_fat_100g": nutrient("saturated-fat_100g"),
        prefix + "salt_100g": nutrient("salt_100g"),
        prefix + "fiber_100g": nutrient("fiber_100g"),
        prefix + "proteins_100g": nutrient("proteins_100g"),
        prefix + "fat_100g": nutrient("fat_100g"),
    })


def products_flat(prefix: str = "") -> dict[str, Column]:
    """Map the reference keys to the columns of the ``products`` table."""
    def c(name):
        return F.col(prefix + name)
    return {
        "product_name": c("product_name"),
        "nutrition_grade_fr": c("nutrition_grade_fr"),
        "nutrition-score-fr_100g": c("nutrition_score_fr_100g"),
        "sugars_100g": c("sugars_100g"),
        "saturated-fat_100g": c("saturated_fat_100g"),
        "salt_100g": c("salt_100g"),
        "fiber_100g": c("fiber_100g"),
        "proteins_100g": c("proteins_100g"),
        "fat_100g": c("fat_100g"),
    }


def num_text(x: Column) -> Column:
    """Python ``str(float)`` for the usual range (0.001 <= |x| < 1e7 and 0)."""
    return x.cast("double").cast("string")


def add_estimate(df: DataFrame, n: str = "_n_", prefix: str = "_e_") -> DataFrame:
    """F13 on normalised columns (``add_normalized``): adds ``grade_estime``,
    ``score_estime``, ``methode`` and ``justification`` (with ``prefix``).

    Official score present -> its grade; otherwise the heuristic points of
    F13a summed over the nutrients present (a missing nutrient adds 0)."""
    official = F.col(n + "nutrition_score_fr")
    sugars, sat, salt = F.col(n + "sugars_100g"), F.col(n + "saturated_fat_100g"), F.col(n + "salt_100g")
    fiber, prot = F.col(n + "fiber_100g"), F.col(n + "proteins_100g")
    pts = (_steps(sugars, HEURISTIC_SUGARS, False) + _steps(sat, HEURISTIC_SAT_FAT, False)
           + _steps(salt, HEURISTIC_SALT, False) + _steps(fiber, HEURISTIC_FIBER, False)
           + _steps(prot, HEURISTIC_PROTEINS, False))
    details = F.concat_ws(
        ", ",
        F.when(sugars.isNotNull(), F.concat(F.lit("sucres="), num_text(sugars), F.lit("g/100g"))),
        F.when(sat.isNotNull(), F.concat(F.lit("graisses saturees="), num_text(sat), F.lit("g/100g"))),
        F.when(salt.isNotNull(), F.concat(F.lit("sel="), num_text(salt), F.lit("g/100g"))),
        F.when(fiber.isNotNull(), F.concat(F.lit("fibres="), num_text(fiber), F.lit("g/100g"))),
        F.when(prot.isNotNull(), F.concat(F.lit("proteines="), num_text(prot), F.lit("g/100g"))),
    )
    df = df.withColumns({prefix + "heur": F.round(pts.cast("double"), 2), prefix + "details": details})
    heur = F.col(prefix + "heur")
    has = official.isNotNull()
    df = df.withColumns({
        prefix + "score_estime": F.when(has, official).otherwise(heur),
        prefix + "methode": F.when(has, F.lit("score_officiel_present")).otherwise(F.lit("heuristique_nutriments")),
    })
    df = df.withColumn(prefix + "grade_estime", score_to_grade(F.col(prefix + "score_estime")))
    text = F.when(
        has,
        F.concat(F.lit("Le score nutritionnel numerique vaut "), num_text(official),
                 F.lit(", ce qui correspond au Nutri-Score "), F.upper(F.col(prefix + "grade_estime")), F.lit(".")),
    ).otherwise(
        F.concat(F.lit("Estimation heuristique basee sur les nutriments disponibles : "), F.col(prefix + "details"),
                 F.lit(". Score estime = "), num_text(heur), F.lit(".")))
    return df.withColumn(prefix + "justification", text).drop(prefix + "heur", prefix + "details")


def add_coherence(df: DataFrame, product_present: Column | None = None, n: str = "_n_", e: str = "_e_",
                  prefix: str = "_c_") -> DataFrame:
    """adds ``statut``, ``message`` and ``grade_actuel`` (with ``prefix``)."""
    df = df.withColumn(prefix + "cur", F.when(F.col(n + "nutrition_grade_fr") != "", F.col(n + "nutrition_grade_fr")))
    current = F.col(prefix + "cur")
    df = df.withColumns({prefix + "r_cur": grade_rank(current), prefix + "r_est": grade_rank(F.col(e + "grade_estime"))})
    r_cur, r_est = F.col(prefix + "r_cur"), F.col(prefix + "r_est")
    gap = F.abs(r_cur - r_est)
    up_cur, up_est = F.upper(current), F.upper(F.col(e + "grade_estime"))
    present = F.lit(True) if product_present is None else product_present
    statut = (F.when(~present, F.lit("inconnu"))
              .when(current.isNull(), F.lit("manquant"))
              .when(r_cur.isNull() | r_est.isNull(), F.lit("inconnu"))
              .when(gap <= 1, F.lit("coherent"))
              .otherwise(F.lit("incoherent")))
    message = (F.when(~present, F.lit("Informations produit manquantes."))
               .when(current.isNull(), F.lit("Nutri-Score absent dans les donnees."))
               .when(r_cur.isNull() | r_est.isNull(),
                     F.lit("Impossible de comparer le Nutri-Score avec certitude."))
               .when(gap <= 1, F.concat(F.lit("Le Nutri-Score "), up_cur,
                                        F.lit(" parait coherent avec l'estimation "), up_est, F.lit(".")))
               .otherwise(F.concat(F.lit("Le Nutri-Score "), up_cur,
                                   F.lit(" semble peu coherent avec l'estimation "), up_est, F.lit("."))))
    comparable = present & current.isNotNull() & r_cur.isNotNull() & r_est.isNotNull()
    return df.withColumns({
        prefix + "statut": statut,
        prefix + "message": message,
        prefix + "grade_actuel": F.when(comparable, current),
    }).drop(prefix + "cur", prefix + "r_cur", prefix + "r_est")


def js_or_zero(x: Column) -> Column:
    """JavaScript ``x || 0`` on a number: null, NaN and 0 give 0."""
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)


def js_or(x: Column, default: Column) -> Column:
    """JavaScript ``x || default`` on text: null and "" fall through."""
    return F.when(x.isNull() | (x == ""), default).otherwise(x)


SCAN_KEYS = [("energy_kj", "energy-kj_100g"), ("fat", "fat_100g"), ("sat_fat", "saturated-fat_100g"),
             ("sugar", "sugars_100g"), ("salt", "salt_100g"), ("fiber", "fiber_100g"),
             ("proteins", "proteins_100g"), ("fruits_veg", "fruits-vegetables-nuts-estimate-from-ingredients_100g")]


def add_scan_score(df: DataFrame, nutriments: Column, prefix: str = "_s_") -> DataFrame:
    """F12a-h: adds the nutrient values used (``fat``, ``sugar``, ... each
    ``x || 0``), ``score_numerique`` and ``nutriscore_predit`` (with ``prefix``)."""
    df = df.withColumns({prefix + name: js_or_zero(nutriments[key]) for name, key in SCAN_KEYS})

    def c(name):
        return F.col(prefix + name)
    df = df.withColumns({
        prefix + "_n": (_steps(c("energy_kj"), SCAN_ENERGY, True) + _steps(c("sugar"), SCAN_SUGAR, True)
                        + _steps(c("sat_fat"), SCAN_SAT_FAT, True) + _steps(c("salt"), SCAN_SALT, True)),
        prefix + "_pf": _steps(c("fiber"), SCAN_FIBER, True),
        prefix + "_pp": _steps(c("proteins"), SCAN_PROTEINS, True),
        prefix + "_pv": _steps(c("fruits_veg"), SCAN_FRUITS, True),
    })
    n, pf, pp, pv = c("_n"), c("_pf"), c("_pp"), c("_pv")
    df = df.withColumn(prefix + "score_numerique",
                       n - F.when((n >= 11) & (pv <= 1), pf + pv).otherwise(pf + pp + pv))
    df = df.withColumn(prefix + "nutriscore_predit", F.upper(score_to_grade(c("score_numerique"))))
    return df.drop(prefix + "_n", prefix + "_pf", prefix + "_pp", prefix + "_pv")
