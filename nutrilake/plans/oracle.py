"""Independent DuckDB SQL for every registered query (the correctness gate).

The driver registers the parquet tables as views; each text below rebuilds
the derived tables of FIXTURES.md in CTEs and answers the query in plain
SQL, written separately from the Spark code.
"""

from __future__ import annotations

S = "VARCHAR"

PRODUCTS = f"""
products AS (
SELECT
  p_partkey AS row_id,
  CAST(3000000000000 + p_partkey AS {S}) AS code,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_name END AS product_name,
  CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE lower(replace(p_brand, '#', '-')) END AS brands_tags,
  CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN ' '
       ELSE concat('Foods, ', p_type) END AS categories_en,
  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 'nan' ELSE n_name END AS countries_en,
  concat('water, sugar, E', CAST(CASE p_partkey % 6 WHEN 0 THEN 100 WHEN 1 THEN 200 WHEN 2 THEN 322
         WHEN 3 THEN 330 WHEN 4 THEN 331 ELSE 951 END AS {S}), ', ', p_name) AS ingredients_text,
  CAST((p_partkey * 41) % 3700 AS DOUBLE) AS energy_100g,
  CASE WHEN p_partkey % 101 = 0 THEN -1e0 ELSE CAST((p_partkey * 37) % 1050 AS DOUBLE) / 1e1 END AS sugars_100g,
  CAST((p_partkey * 53) % 130 AS DOUBLE) / 1e1 AS saturated_fat_100g,
  CAST((p_partkey * 53) % 130 + (p_partkey * 17) % 400 AS DOUBLE) / 1e1 AS fat_100g,
  CASE WHEN p_partkey % 97 = 0 THEN 1e2 ELSE CAST((p_partkey * 29) % 300 AS DOUBLE) / 1e2 END AS salt_100g,
  CASE WHEN p_partkey % 97 = 0 THEN 4e1 ELSE CAST((p_partkey * 29) % 300 AS DOUBLE) / 1e2 / 2.5e0 END AS sodium_100g,
  CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST((p_partkey * 13) % 120 AS DOUBLE) / 1e1 END AS fiber_100g,
  CAST((p_partkey * 19) % 250 AS DOUBLE) / 1e1 AS proteins_100g,
  CAST((p_partkey * 7) % 101 AS DOUBLE) AS fruits_100g,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST((p_partkey * 11) % 60 - 15 AS INT) END AS nutrition_score_fr_100g,
  CASE p_partkey % 7 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'd' WHEN 4 THEN 'E'
       WHEN 5 THEN 'unknown' ELSE NULL END AS nutrition_grade_fr
FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 25
)"""

CLEANED = """
cleaned AS (
SELECT row_id, product_name, brands_tags, categories_en, countries_en, ingredients_text, energy_100g,
       fat_100g, saturated_fat_100g, sugars_100g, fiber_100g, proteins_100g, salt_100g, sodium_100g,
       code, nutrition_score_fr_100g
FROM products
WHERE NOT (product_name IS NULL OR nutrition_score_fr_100g IS NULL OR brands_tags IS NULL
           OR categories_en IS NULL
           OR coalesce(sugars_100g > 100, false) OR coalesce(sugars_100g < 0, false)
           OR coalesce(salt_100g >= 100, false) OR coalesce(sodium_100g >= 100, false))
)"""

DISTRIBUTORS = """
distributor AS (
SELECT * FROM (VALUES ('Carrefour', '2025'), ('Auchan', '2024'), ('Leclerc', '2023'),
                      ('Lidl', '2022'), ('Intermarche', '2021')) AS t(Distributeur, Temps)
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


ORACLE: dict[str, str] = {}

ORACLE["clean_products"] = with_(PRODUCTS, CLEANED) + "SELECT * FROM cleaned"

ORACLE["distributor_avg_score"] = with_(PRODUCTS, CLEANED, DISTRIBUTORS) + """
SELECT Distributeur, avg(nutrition_score_fr_100g) AS avg_nutrition_score
FROM cleaned CROSS JOIN distributor
GROUP BY Distributeur"""

# --- grading -----------------------------------------------------------------

ESTIMATE = """
norm AS (
SELECT row_id, code, nutrition_grade_fr,
  CAST(nutrition_score_fr_100g AS DOUBLE) AS off_score,
  CASE WHEN sugars_100g <> 0 THEN sugars_100g END AS n_sug,
  CASE WHEN saturated_fat_100g <> 0 THEN saturated_fat_100g END AS n_sat,
  CASE WHEN salt_100g <> 0 THEN salt_100g END AS n_salt,
  CASE WHEN fiber_100g <> 0 THEN fiber_100g END AS n_fib,
  CASE WHEN proteins_100g <> 0 THEN proteins_100g END AS n_pro
FROM products),
heur AS (
SELECT *, CAST(
   (CASE WHEN n_sug >= 45 THEN 10 WHEN n_sug >= 31 THEN 7 WHEN n_sug >= 18 THEN 5 WHEN n_sug >= 9 THEN 2 ELSE 0 END)
 + (CASE WHEN n_sat >= 10 THEN 10 WHEN n_sat >= 5 THEN 7 WHEN n_sat >= 2 THEN 4 WHEN n_sat >= 1 THEN 2 ELSE 0 END)
 + (CASE WHEN n_salt >= 1.5 THEN 8 WHEN n_salt >= 1 THEN 6 WHEN n_salt >= 0.6 THEN 4 WHEN n_salt >= 0.3 THEN 2 ELSE 0 END)
 - (CASE WHEN n_fib >= 7 THEN 5 WHEN n_fib >= 4 THEN 3 WHEN n_fib >= 2 THEN 1 ELSE 0 END)
 - (CASE WHEN n_pro >= 8 THEN 2 WHEN n_pro >= 4 THEN 1 ELSE 0 END) AS DOUBLE) AS h_score
FROM norm),
est0 AS (
SELECT *, coalesce(off_score, h_score) AS score_estime FROM heur),
est AS (
SELECT *,
  CASE WHEN score_estime <= -1 THEN 'a' WHEN score_estime <= 2 THEN 'b' WHEN score_estime <= 10 THEN 'c'
       WHEN score_estime <= 18 THEN 'd' ELSE 'e' END AS grade_estime,
  CASE WHEN off_score IS NOT NULL THEN 'score_officiel_present' ELSE 'heuristique_nutriments' END AS methode
FROM est0),
est2 AS (
SELECT *,
  CASE WHEN off_score IS NOT NULL
       THEN 'Le score nutritionnel numerique vaut ' || CAST(off_score AS VARCHAR)
            || ', ce qui correspond au Nutri-Score ' || upper(grade_estime) || '.'
       ELSE 'Estimation heuristique basee sur les nutriments disponibles : '
            || concat_ws(', ',
                 CASE WHEN n_sug IS NOT NULL THEN 'sucres=' || CAST(n_sug AS VARCHAR) || 'g/100g' END,
                 CASE WHEN n_sat IS NOT NULL THEN 'graisses saturees=' || CAST(n_sat AS VARCHAR) || 'g/100g' END,
                 CASE WHEN n_salt IS NOT NULL THEN 'sel=' || CAST(n_salt AS VARCHAR) || 'g/100g' END,
                 CASE WHEN n_fib IS NOT NULL THEN 'fibres=' || CAST(n_fib AS VARCHAR) || 'g/100g' END,
                 CASE WHEN n_pro IS NOT NULL THEN 'proteines=' || CAST(n_pro AS VARCHAR) || 'g/100g' END)
            || '. Score estime = ' || CAST(h_score AS VARCHAR) || '.'
  END AS justification
FROM est)"""

SCORED = """
scored AS (
SELECT row_id, code, lower(nutrition_grade_fr) AS actual, grade_estime AS predicted FROM est2)"""

ORACLE["heuristic_grade"] = with_(PRODUCTS, ESTIMATE) + """
SELECT row_id, code, grade_estime, score_estime, methode, justification FROM est2"""

ORACLE["grade_coherence"] = with_(PRODUCTS, ESTIMATE) + """,
cur AS (
SELECT row_id, code, grade_estime,
  CASE WHEN nutrition_grade_fr IS NULL OR nutrition_grade_fr IN ('', 'null', 'None') THEN NULL
       ELSE lower(nutrition_grade_fr) END AS g
FROM est2),
rk AS (
SELECT *,
  CASE g WHEN 'a' THEN 0 WHEN 'b' THEN 1 WHEN 'c' THEN 2 WHEN 'd' THEN 3 WHEN 'e' THEN 4 END AS r_cur,
  CASE grade_estime WHEN 'a' THEN 0 WHEN 'b' THEN 1 WHEN 'c' THEN 2 WHEN 'd' THEN 3 WHEN 'e' THEN 4 END AS r_est
FROM cur)
SELECT row_id, code,
  CASE WHEN g IS NULL THEN 'manquant' WHEN r_cur IS NULL OR r_est IS NULL THEN 'inconnu'
       WHEN abs(r_cur - r_est) <= 1 THEN 'coherent' ELSE 'incoherent' END AS statut,
  CASE WHEN g IS NULL THEN 'Nutri-Score absent dans les donnees.'
       WHEN r_cur IS NULL OR r_est IS NULL THEN 'Impossible de comparer le Nutri-Score avec certitude.'
       WHEN abs(r_cur - r_est) <= 1
       THEN 'Le Nutri-Score ' || upper(g) || ' parait coherent avec l''estimation ' || upper(grade_estime) || '.'
       ELSE 'Le Nutri-Score ' || upper(g) || ' semble peu coherent avec l''estimation ' || upper(grade_estime) || '.'
  END AS message,
  CASE WHEN g IS NOT NULL AND r_cur IS NOT NULL AND r_est IS NOT NULL THEN g END AS grade_actuel,
  grade_estime
FROM rk"""

ORACLE["rule_ok_diff"] = with_(PRODUCTS, ESTIMATE, SCORED) + """
SELECT row_id, code, actual, predicted,
  CASE WHEN actual = predicted THEN 'OK' ELSE 'DIFF' END AS comparaison_nutri
FROM scored"""

ORACLE["ok_diff_counts"] = with_(PRODUCTS, ESTIMATE, SCORED) + """
SELECT CASE WHEN actual = predicted THEN 'OK' ELSE 'DIFF' END AS comparaison_nutri,
       count(*) AS "Count(product_name)"
FROM scored GROUP BY 1"""

ORACLE["confusion_matrix"] = with_(PRODUCTS, ESTIMATE, SCORED) + """
SELECT actual,
  CAST(sum(CASE WHEN predicted = 'a' THEN 1 ELSE 0 END) AS BIGINT) AS a,
  CAST(sum(CASE WHEN predicted = 'b' THEN 1 ELSE 0 END) AS BIGINT) AS b,
  CAST(sum(CASE WHEN predicted = 'c' THEN 1 ELSE 0 END) AS BIGINT) AS c,
  CAST(sum(CASE WHEN predicted = 'd' THEN 1 ELSE 0 END) AS BIGINT) AS d,
  CAST(sum(CASE WHEN predicted = 'e' THEN 1 ELSE 0 END) AS BIGINT) AS e,
  CAST(sum(CASE WHEN predicted = 'unknown' THEN 1 ELSE 0 END) AS BIGINT) AS "unknown"
FROM scored WHERE actual IS NOT NULL AND predicted IS NOT NULL
GROUP BY actual"""

CLASS_TABLE = """,
pairs AS (
SELECT actual, predicted, count(*) AS n FROM scored
WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY actual, predicted),
cls AS (SELECT actual AS c FROM pairs UNION SELECT predicted FROM pairs),
per AS (
SELECT c,
  CAST(sum(CASE WHEN actual = c AND predicted = c THEN n ELSE 0 END) AS BIGINT) AS TP,
  CAST(sum(CASE WHEN predicted = c AND actual <> c THEN n ELSE 0 END) AS BIGINT) AS FP,
  CAST(sum(CASE WHEN actual = c AND predicted <> c THEN n ELSE 0 END) AS BIGINT) AS FN,
  CAST(sum(n) AS BIGINT) AS total
FROM cls, pairs GROUP BY c),
m AS (
SELECT c, TP, FP, FN, total - TP - FP - FN AS TN,
  CASE WHEN TP + FN = 0 THEN NULL ELSE CAST(TP AS DOUBLE) / CAST(TP + FN AS DOUBLE) END AS recall,
  CASE WHEN TP + FP = 0 THEN NULL ELSE CAST(TP AS DOUBLE) / CAST(TP + FP AS DOUBLE) END AS precision
FROM per)"""

ORACLE["class_scores"] = with_(PRODUCTS, ESTIMATE, SCORED) + CLASS_TABLE + """
SELECT c AS "class", TP, FP, TN, FN, recall, precision, recall AS sensitivity,
  CASE WHEN TN + FP = 0 THEN NULL ELSE CAST(TN AS DOUBLE) / CAST(TN + FP AS DOUBLE) END AS specificity,
  CASE WHEN precision + recall = 0 THEN NULL ELSE 2 * precision * recall / (precision + recall) END AS f_measure
FROM m"""

ORACLE["overall_scores"] = with_(PRODUCTS, ESTIMATE, SCORED) + CLASS_TABLE + """,
o AS (
SELECT CAST(sum(TP) AS BIGINT) AS n_correct, CAST(sum(FN) AS BIGINT) AS n_false,
       CAST(sum((TP + FN) * (TP + FP)) AS BIGINT) AS marg FROM m),
o2 AS (
SELECT *, CAST(n_correct + n_false AS DOUBLE) AS n FROM o)
SELECT n_correct / n AS accuracy, n_false / n AS error, n_correct, n_false,
  CASE WHEN 1.0e0 - marg / (n * n) = 0 THEN NULL
       ELSE (n_correct / n - marg / (n * n)) / (1.0e0 - marg / (n * n)) END AS cohen_kappa
FROM o2"""

EXTERNAL = """
external AS (
SELECT row_id, code, product_name, brands_tags AS brands,
  CASE WHEN row_id % 2 = 0 THEN countries_en END AS countries,
  CASE WHEN countries_en IS NULL THEN NULL ELSE [concat('en:', lower(countries_en))] END AS countries_tags,
  nutrition_grade_fr AS nutrition_grades,
  CASE WHEN row_id % 2 = 0 THEN concat('https://images.example/', code, '/front.jpg') END AS image_front_url,
  CASE WHEN row_id % 5 <> 0 THEN concat('https://images.example/', code, '.jpg') END AS image_url,
  nutrition_score_fr_100g,
  energy_100g AS x_energy, fat_100g AS x_fat, saturated_fat_100g AS x_sat, sugars_100g AS x_sugar,
  salt_100g AS x_salt, fiber_100g AS x_fiber, proteins_100g AS x_prot, fruits_100g AS x_fruits
FROM products WHERE row_id % 3 = 0)"""

SCAN = """,
z AS (
SELECT code, product_name, brands, nutrition_grades, image_front_url, image_url,
  CASE WHEN x_energy IS NULL OR isnan(x_energy) OR x_energy = 0 THEN 0e0 ELSE x_energy END AS energy,
  CASE WHEN x_fat IS NULL OR isnan(x_fat) OR x_fat = 0 THEN 0e0 ELSE x_fat END AS fat,
  CASE WHEN x_sat IS NULL OR isnan(x_sat) OR x_sat = 0 THEN 0e0 ELSE x_sat END AS sat,
  CASE WHEN x_sugar IS NULL OR isnan(x_sugar) OR x_sugar = 0 THEN 0e0 ELSE x_sugar END AS sugar,
  CASE WHEN x_salt IS NULL OR isnan(x_salt) OR x_salt = 0 THEN 0e0 ELSE x_salt END AS salt,
  CASE WHEN x_fiber IS NULL OR isnan(x_fiber) OR x_fiber = 0 THEN 0e0 ELSE x_fiber END AS fiber,
  CASE WHEN x_prot IS NULL OR isnan(x_prot) OR x_prot = 0 THEN 0e0 ELSE x_prot END AS prot,
  CASE WHEN x_fruits IS NULL OR isnan(x_fruits) OR x_fruits = 0 THEN 0e0 ELSE x_fruits END AS fruits
FROM external),
pts AS (
SELECT *,
  (CASE WHEN energy > 3350 THEN 10 WHEN energy > 3015 THEN 9 WHEN energy > 2680 THEN 8 WHEN energy > 2345 THEN 7
        WHEN energy > 2010 THEN 6 WHEN energy > 1675 THEN 5 WHEN energy > 1340 THEN 4 WHEN energy > 1005 THEN 3
        WHEN energy > 670 THEN 2 WHEN energy > 335 THEN 1 ELSE 0 END)
  + (CASE WHEN sugar > 45 THEN 10 WHEN sugar > 36 THEN 9 WHEN sugar > 27 THEN 7 WHEN sugar > 18 THEN 6
          WHEN sugar > 9 THEN 3 WHEN sugar > 4.5 THEN 1 ELSE 0 END)
  + (CASE WHEN sat > 10 THEN 10 WHEN sat > 8 THEN 9 WHEN sat > 6 THEN 7 WHEN sat > 4 THEN 6
          WHEN sat > 2 THEN 3 WHEN sat > 1 THEN 1 ELSE 0 END)
  + (CASE WHEN salt > 2.3 THEN 10 WHEN salt > 1.5 THEN 9 WHEN salt > 0.9 THEN 7 WHEN salt > 0.6 THEN 6
          WHEN salt > 0.3 THEN 3 WHEN salt > 0.15 THEN 1 ELSE 0 END) AS n_pts,
  CASE WHEN fiber > 4.7 THEN 5 WHEN fiber > 3.7 THEN 4 WHEN fiber > 2.8 THEN 3 WHEN fiber > 1.9 THEN 2
       WHEN fiber > 0.9 THEN 1 ELSE 0 END AS p_fiber,
  CASE WHEN prot > 8 THEN 5 WHEN prot > 6.4 THEN 4 WHEN prot > 4.8 THEN 3 WHEN prot > 3.2 THEN 2
       WHEN prot > 1.6 THEN 1 ELSE 0 END AS p_prot,
  CASE WHEN fruits > 80 THEN 5 WHEN fruits > 60 THEN 2 WHEN fruits > 40 THEN 1 ELSE 0 END AS p_fruits
FROM z),
sc AS (
SELECT *, n_pts - CASE WHEN n_pts >= 11 AND p_fruits <= 1 THEN p_fiber + p_fruits
                       ELSE p_fiber + p_prot + p_fruits END AS score_numerique
FROM pts)"""

ORACLE["nutriment_score"] = with_(PRODUCTS, EXTERNAL) + SCAN + """
SELECT code,
  CASE WHEN product_name IS NULL OR product_name = '' THEN 'Inconnu' ELSE product_name END AS product_name,
  CASE WHEN brands IS NULL OR brands = '' THEN 'Inconnu' ELSE brands END AS brands,
  CASE WHEN score_numerique <= -1 THEN 'A' WHEN score_numerique <= 2 THEN 'B' WHEN score_numerique <= 10 THEN 'C'
       WHEN score_numerique <= 18 THEN 'D' ELSE 'E' END AS nutriscore_predit,
  CASE WHEN nutrition_grades IS NULL OR nutrition_grades = '' THEN 'Non disponible' ELSE nutrition_grades END
    AS nutriscore_officiel,
  score_numerique, fat, sugar, salt, prot AS proteins, fiber, energy AS energy_kj, sat AS sat_fat,
  fruits AS fruits_veg,
  CASE WHEN image_front_url IS NOT NULL AND image_front_url <> '' THEN image_front_url
       WHEN image_url IS NOT NULL AND image_url <> '' THEN image_url END AS image_url
FROM sc"""

# --- profile and domains -------------------------------------------------------

CLEAN_COLS = [
    ("row_id", "bigint"), ("product_name", "string"), ("brands_tags", "string"), ("categories_en", "string"),
    ("countries_en", "string"), ("ingredients_text", "string"), ("energy_100g", "double"),
    ("fat_100g", "double"), ("saturated_fat_100g", "double"), ("sugars_100g", "double"),
    ("fiber_100g", "double"), ("proteins_100g", "double"), ("salt_100g", "double"), ("sodium_100g", "double"),
    ("code", "string"), ("nutrition_score_fr_100g", "int"),
]


def _profile_sql() -> str:
    parts = []
    for c, t in CLEAN_COLS:
        num = t != "string"
        x = f"CAST({c} AS DOUBLE)"
        if num:
            stats = (f"round(min({x}), 6), round(max({x}), 6), round(quantile_disc({x}, 0.25), 6), "
                     f"round(quantile_disc({x}, 0.5), 6), round(quantile_disc({x}, 0.75), 6), "
                     f"round(avg({x}), 6), round(avg(abs({x} - (SELECT avg({x}) FROM cleaned))), 6), "
                     f"round(stddev_samp({x}), 6), round(sum({x}), 6)")
        else:
            stats = ", ".join(["CAST(NULL AS DOUBLE)"] * 9)
        parts.append(
            f"SELECT '{c}' AS column_name, '{t}' AS column_type, count(*) - count({c}) AS n_missing, "
            f"count(DISTINCT {c}) AS n_unique, {stats} FROM cleaned")
    top = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM cleaned WHERE {c} IS NOT NULL"
        for c, _ in CLEAN_COLS)
    return with_(PRODUCTS, CLEANED) + f""",
stats(column_name, column_type, n_missing, n_unique, min_value, max_value, q25, q50, q75, mean, mad, stddev,
      "sum") AS ({" UNION ALL ".join(parts)}),
vals AS ({top}),
cnt AS (SELECT column_name, value, count(*) AS n FROM vals GROUP BY column_name, value),
rk AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value ASC) AS r FROM cnt),
top AS (SELECT column_name, string_agg(value || ':' || CAST(n AS VARCHAR), ', ' ORDER BY r) AS top_values
        FROM rk WHERE r <= 10 GROUP BY column_name)
SELECT stats.*, top.top_values FROM stats LEFT JOIN top USING (column_name)"""


ORACLE["column_profile"] = _profile_sql()


def _domains_sql() -> str:
    cols = CLEAN_COLS + [("Distributeur", "string"), ("Temps", "string")]
    parts = []
    for c, t in cols:
        if t != "string":
            parts.append(f"SELECT '{c}' AS column_name, min(CAST({c} AS DOUBLE)) AS lower_bound, "
                         f"max(CAST({c} AS DOUBLE)) AS upper_bound, CAST(NULL AS BIGINT) AS n_values, "
                         f"CAST(NULL AS VARCHAR) AS possible_values FROM dist")
        else:
            parts.append(f"SELECT '{c}', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), count(DISTINCT {c}), "
                         f"CASE WHEN count(DISTINCT {c}) <= 60 THEN "
                         f"array_to_string(list_sort(list(DISTINCT {c})), '|') END FROM dist")
    return with_(PRODUCTS, CLEANED, DISTRIBUTORS) + """,
dist AS (SELECT * FROM cleaned CROSS JOIN distributor)
""" + " UNION ALL ".join(parts)


ORACLE["column_domains"] = _domains_sql()

ORACLE["domain_values"] = with_(PRODUCTS, CLEANED) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM cleaned WHERE {c} IS NOT NULL GROUP BY {c}"
    for c, t in CLEAN_COLS if t == "string")

# --- questions and lookups -------------------------------------------------------

QUESTIONS = f"""
questions_t AS (
SELECT p_partkey AS q_id, CAST(floor(p_partkey / 2e1) AS BIGINT) AS conv_id, p_partkey % 20 AS turn,
  CASE p_partkey % 9
    WHEN 0 THEN 'Explique l’additif E330'
    WHEN 1 THEN 'Trouve des produits similaires mieux notes'
    WHEN 2 THEN concat('Propose une catégorie pour "', p_name, '"')
    WHEN 3 THEN concat('Le pays est manquant pour le code-barres ', CAST(3000000000000 + p_partkey AS {S}))
    WHEN 4 THEN 'Ce Nutri-Score est-il cohérent ?'
    WHEN 5 THEN concat('Estime le nutriscore de "', p_name, '"')
    WHEN 6 THEN 'e150a est-il sain ?'
    WHEN 7 THEN 'E 322 : quel role ?'
    ELSE 'Bonjour' END AS question,
  CASE WHEN p_partkey % 9 IN (1, 4) THEN p_name ELSE NULL END AS indice_produit,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(3000000000000 + p_partkey AS {S}) ELSE NULL END AS codebarres
FROM part),
qx AS (
SELECT *,
  regexp_extract(upper(question), '\\bE\\s?([0-9]{{3,4}}[a-z]?)\\b', 1) AS _add,
  nullif(regexp_extract(question, '\\b([0-9]{{8,14}})\\b', 1), '') AS _bc,
  regexp_extract_all(question, '"([^"]+)"', 1) AS textes
FROM questions_t),
qe AS (
SELECT *,
  CASE WHEN _add <> '' OR contains(lower(question), 'additif') THEN 'additif'
       WHEN contains(lower(question), 'similaire') OR contains(lower(question), 'mieux not') THEN 'similarite'
       WHEN contains(lower(question), 'catégorie') OR contains(lower(question), 'categorie') THEN 'categorie'
       WHEN contains(lower(question), 'pays') OR contains(lower(question), 'origine') THEN 'origine'
       WHEN contains(lower(question), 'cohérent') OR contains(lower(question), 'coherent') THEN 'coherence'
       WHEN contains(lower(question), 'nutri-score') OR contains(lower(question), 'nutriscore')
         THEN 'estimer_nutriscore'
       ELSE 'rag' END AS intention,
  CASE WHEN codebarres IS NOT NULL AND codebarres <> '' THEN trim(codebarres) ELSE _bc END AS codebarres_effectif,
  CASE WHEN _add <> '' THEN 'E' || upper(_add) END AS code_additif,
  coalesce(nullif(trim(codebarres), ''), nullif(trim(indice_produit), ''), nullif(trim(_bc), ''), '')
    AS reference_deduite
FROM qx)"""

ADDITIVES_SQL = """
additives_t AS (
SELECT * FROM (VALUES
 ('E100', 'Curcumine', 'colorant', 'Colorant jaune d''origine naturelle, souvent extrait du curcuma.',
  'Open Food Facts', 'https://fr.openfoodfacts.org/additif/e100-curcumine'),
 ('E200', 'Acide sorbique', 'conservateur',
  'Conservateur utilisé pour limiter le développement de levures et moisissures.',
  'Open Food Facts', 'https://fr.openfoodfacts.org/additif/e200-acide-sorbique'),
 ('E202', 'Sorbate de potassium', 'conservateur',
  'Sel de l''acide sorbique, utilisé pour prolonger la conservation des aliments.',
  'Open Food Facts', 'https://fr.openfoodfacts.org/additif/e202-sorbate-de-potassium'),
 ('E300', 'Acide ascorbique', 'antioxydant', 'Vitamine C utilisée comme antioxydant pour limiter l''oxydation.',
  'Open Food Facts', 'https://fr.openfoodfacts.org/additif/e300-acide-ascorbique'),
 ('E322', 'Lécithines', 'émulsifiant', 'Famille d''émulsifiants utilisés pour stabiliser les mélanges eau/gras.',
  'Open Food Facts', 'https://fr.openfoodfacts.org/additif/e322-lecithines'),
 ('E330', 'Acide citrique', 'acidifiant',
  'Acidifiant très courant qui ajuste l''acidité et améliore parfois la conservation ou le goût.',
  'Open Food Facts', 'https://fr.openfoodfacts.org/additif/e330-acide-citrique'),
 ('E331', 'Citrates de sodium', 'correcteur d''acidité',
  'Régule l''acidité et peut stabiliser certaines boissons et préparations.',
  'Open Food Facts', 'https://fr.openfoodfacts.org/additif/e331-citrates-de-sodium')
) AS t(code, nom, role, description, source_nom, url_source))"""

ORACLE["question_intents"] = with_(QUESTIONS) + """
SELECT q_id, intention, codebarres_effectif, code_additif, reference_deduite,
  len(textes) AS n_guillemets, textes[1] AS premier_guillemet
FROM qe"""

ORACLE["barcode_lookup"] = with_(PRODUCTS, QUESTIONS) + """,
f AS (SELECT trim(code) AS c, min(row_id) AS rid FROM products GROUP BY trim(code))
SELECT q.q_id, q.codebarres, p.row_id, p.product_name
FROM questions_t q LEFT JOIN f ON f.c = trim(q.codebarres) LEFT JOIN products p ON p.row_id = f.rid
WHERE trim(q.codebarres) <> ''"""

ORACLE["name_search"] = with_(PRODUCTS, QUESTIONS) + """,
hints AS (SELECT q_id, lower(trim(indice_produit)) AS h FROM questions_t WHERE trim(indice_produit) <> ''),
m AS (SELECT q_id, row_id, product_name, row_number() OVER (PARTITION BY q_id ORDER BY row_id) AS pos
      FROM hints JOIN products ON contains(lower(product_name), h))
SELECT q_id, CAST(pos AS INTEGER) AS pos, row_id, product_name FROM m WHERE pos <= 5"""

ORACLE["keyword_search"] = with_(PRODUCTS, QUESTIONS) + r""",
ext AS (SELECT code, product_name, CASE WHEN row_id % 2 = 0 THEN countries_en END AS countries, categories_en AS categories,
               nutrition_grade_fr AS nutriscore_grade FROM products WHERE row_id % 3 = 0),
fields AS (SELECT code AS key, code AS f, 8 AS points FROM ext UNION ALL SELECT code, product_name, 4 FROM ext
           UNION ALL SELECT code, categories, 2 FROM ext UNION ALL SELECT code, countries, 1 FROM ext UNION ALL SELECT code, nutriscore_grade, 1 FROM ext),
held AS (SELECT key, word, max(points) AS points FROM (SELECT key, points, unnest(regexp_extract_all(lower(f), '[\p{L}\p{N}]+')) AS word FROM fields) GROUP BY key, word),
asked AS (SELECT DISTINCT q_id, unnest(regexp_extract_all(lower(concat_ws(' ', question, indice_produit)), '[\p{L}\p{N}]+')) AS word FROM questions_t),
m AS (SELECT q_id, key, count(*) AS n_words, sum(points) AS points FROM asked JOIN held USING (word) GROUP BY q_id, key),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY n_words DESC, points DESC, key) AS pos FROM m)
SELECT q_id, CAST(pos AS INTEGER) AS pos, CAST(n_words AS INTEGER) AS n_words, CAST(points AS INTEGER) AS points,
       code, product_name, countries, categories, nutriscore_grade
FROM r JOIN ext ON ext.code = r.key WHERE pos <= 5"""

ORACLE["name_regex_search"] = with_(PRODUCTS, QUESTIONS) + r""",
hints AS (SELECT q_id, trim(indice_produit) AS hint, string_split(trim(indice_produit), ' ') AS w FROM questions_t WHERE trim(indice_produit) <> ''),
ws AS (SELECT q_id, hint, coalesce(w[1], 'zz') AS a, coalesce(w[2], 'zz') AS b, coalesce(w[3], 'zz') AS c, coalesce(w[4], 'zz') AS d FROM hints),
pats AS (SELECT q_id, CASE length(hint) % 8 WHEN 0 THEN a || '.*' || c WHEN 1 THEN '(' || a || '|' || b || ') ' || c WHEN 2 THEN '^' || b || '\b'
         WHEN 3 THEN substr(a, 1, 2) || '[aeiou].*' || d WHEN 4 THEN a || 's? [a-m]' WHEN 5 THEN b || '( [a-z]+){2}$'
         WHEN 6 THEN '(?:' || a || ' )?' || b || '.+' || c ELSE hint END AS pattern FROM ws),
m AS (SELECT q_id, pattern, row_id, product_name, row_number() OVER (PARTITION BY q_id ORDER BY row_id) AS pos
      FROM pats JOIN products ON regexp_matches(product_name, pattern, 'i'))
SELECT q_id, pattern, CAST(pos AS INTEGER) AS pos, row_id, product_name FROM m WHERE pos <= 5"""

ORACLE["sql_search"] = with_(PRODUCTS, QUESTIONS) + """,
refs AS (SELECT q_id, reference_deduite AS ref FROM qe WHERE reference_deduite <> ''),
m AS (SELECT q_id, row_id, code, product_name, row_number() OVER (PARTITION BY q_id ORDER BY row_id) AS pos
      FROM refs JOIN products
        ON trim(code) = ref OR lower(product_name) LIKE lower('%' || ref || '%'))
SELECT q_id, CAST(pos AS INTEGER) AS pos, row_id, code, product_name FROM m WHERE pos <= 5"""

ORACLE["resolve_reference"] = with_(PRODUCTS, QUESTIONS) + """,
refs AS (SELECT q_id, reference_deduite AS ref FROM qe WHERE reference_deduite <> ''),
bc AS (SELECT q_id, min(row_id) AS code_row FROM refs JOIN products ON trim(code) = ref GROUP BY q_id),
nm AS (SELECT q_id, min(row_id) AS name_row FROM refs
       JOIN products ON contains(lower(product_name), lower(ref)) GROUP BY q_id)
SELECT r.q_id, r.ref,
  CASE WHEN code_row IS NOT NULL THEN 'code' WHEN name_row IS NOT NULL THEN 'nom' END AS via,
  coalesce(code_row, name_row) AS row_id, p.code, p.product_name
FROM refs r LEFT JOIN bc USING (q_id) LEFT JOIN nm USING (q_id)
LEFT JOIN products p ON p.row_id = coalesce(code_row, name_row)"""

ORACLE["resolve_question"] = with_(PRODUCTS, QUESTIONS) + """,
c0 AS (SELECT q_id, 0 AS prio, 0 AS qpos, min(row_id) AS row_id FROM qe
       JOIN products ON trim(code) = trim(codebarres_effectif) GROUP BY q_id),
quoted AS (SELECT q_id, unnest(textes) AS needle, unnest(range(len(textes))) AS qpos FROM qe),
needles AS (
  SELECT q_id, 1 AS prio, 0 AS qpos, trim(indice_produit) AS needle FROM qe WHERE trim(indice_produit) <> ''
  UNION ALL
  SELECT q_id, 2, qpos, trim(needle) FROM quoted WHERE trim(needle) <> ''),
c1 AS (SELECT q_id, prio, qpos, min(row_id) AS row_id FROM needles
       JOIN products ON contains(lower(product_name), lower(needle)) GROUP BY q_id, prio, qpos),
allc AS (SELECT * FROM c0 UNION ALL SELECT * FROM c1),
best AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY prio, qpos, row_id) AS r FROM allc)
SELECT q.q_id, CASE b.prio WHEN 0 THEN 'code' WHEN 1 THEN 'indice' WHEN 2 THEN 'guillemets' END AS via,
  b.row_id, p.code, p.product_name
FROM qe q LEFT JOIN best b ON b.q_id = q.q_id AND b.r = 1 LEFT JOIN products p ON p.row_id = b.row_id"""

ADDITIVE_SHEET = """
  coalesce(a.nom, 'Additif non repertorie localement') AS nom,
  coalesce(a.role, 'inconnu') AS role,
  coalesce(a.description, 'Aucune fiche locale n''est disponible. Une verification externe est necessaire.')
    AS description,
  coalesce(a.source_nom, 'Open Food Facts') AS source_nom,
  coalesce(a.url_source, 'https://fr.openfoodfacts.org/recherche?search_terms=' || x.code_additif) AS url_source"""

ORACLE["additive_lookup"] = with_(QUESTIONS, ADDITIVES_SQL) + """,
x AS (SELECT q_id, code_additif FROM qe WHERE code_additif IS NOT NULL),
y AS (SELECT x.q_id, x.code_additif, """ + ADDITIVE_SHEET + """
      FROM x LEFT JOIN additives_t a ON a.code = x.code_additif)
SELECT *, code_additif || ' - ' || nom || ' (' || role || ') : ' || description || ' Source : ' || source_nom
          || ' - ' || url_source AS phrase
FROM y"""

ORACLE["additive_mining"] = with_(PRODUCTS, ADDITIVES_SQL) + """,
codes AS (SELECT DISTINCT row_id, 'E' || upper(c) AS code_additif FROM (
  SELECT row_id, unnest(regexp_extract_all(upper(ingredients_text), '\\bE\\s?([0-9]{3,4}[a-z]?)\\b', 1)) AS c
  FROM products)),
x AS (SELECT code_additif, count(*) AS n_products FROM codes GROUP BY code_additif)
SELECT x.code_additif, x.n_products,
  coalesce(a.nom, 'Additif non repertorie localement') AS nom, coalesce(a.role, 'inconnu') AS role,
  coalesce(a.url_source, 'https://fr.openfoodfacts.org/recherche?search_terms=' || x.code_additif) AS url_source
FROM x LEFT JOIN additives_t a ON a.code = x.code_additif"""

MISSING_COUNTRY = """
todo AS (
SELECT row_id, code, product_name, countries_en FROM products
WHERE countries_en IS NULL OR lower(trim(countries_en)) IN ('nan', '', 'null', 'none'))"""

ORACLE["missing_country"] = with_(PRODUCTS, MISSING_COUNTRY) + "SELECT * FROM todo"

ORACLE["country_completion"] = with_(PRODUCTS, MISSING_COUNTRY, EXTERNAL) + """,
j AS (SELECT t.*, e.code AS ecode, e.countries, e.countries_tags
      FROM todo t LEFT JOIN external e ON e.code = trim(t.code)),
k AS (SELECT *, coalesce(CASE WHEN countries <> '' THEN countries END,
                         CASE WHEN len(countries_tags) > 0 THEN array_to_string(countries_tags, ', ') END,
                         '') AS txt FROM j)
SELECT row_id, code, product_name, countries_en,
  CASE WHEN ecode IS NOT NULL AND txt <> '' THEN txt ELSE 'information non trouvee' END AS pays,
  CASE WHEN ecode IS NOT NULL AND txt <> '' THEN txt ELSE countries_en END AS countries_completed,
  CASE WHEN ecode IS NULL THEN 'Produit introuvable' END AS erreur
FROM k"""

# --- memory, sampling, documents, reference scan ----------------------------------

ORACLE["memory_window"] = with_(QUESTIONS) + """
SELECT conv_id, turn, q_id, intention FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM qe) WHERE rn <= 12"""

ORACLE["recent_context"] = """
WITH c AS (
SELECT conv_id, turn, 'Q=' || text || ' | intention=' ||
  CASE WHEN regexp_extract(upper(text), '\\bE\\s?([0-9]{3,4}[a-z]?)\\b', 1) <> ''
            OR contains(lower(text), 'additif') THEN 'additif'
       WHEN contains(lower(text), 'similaire') OR contains(lower(text), 'mieux not') THEN 'similarite'
       WHEN contains(lower(text), 'catégorie') OR contains(lower(text), 'categorie') THEN 'categorie'
       WHEN contains(lower(text), 'pays') OR contains(lower(text), 'origine') THEN 'origine'
       WHEN contains(lower(text), 'cohérent') OR contains(lower(text), 'coherent') THEN 'coherence'
       WHEN contains(lower(text), 'nutri-score') OR contains(lower(text), 'nutriscore') THEN 'estimer_nutriscore'
       ELSE 'rag' END
  || ' | resume=' || substring(replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' '), 1, 260) AS line
FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM c),
h AS (
SELECT a.conv_id, a.turn, b.turn AS bt, b.line,
       row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn) AS i
FROM p a JOIN p b ON b.conv_id = a.conv_id AND b.pos < a.pos AND b.pos >= a.pos - 5),
g AS (SELECT conv_id, turn, string_agg(CAST(i AS VARCHAR) || '. ' || line, chr(10) ORDER BY bt) AS ctx
      FROM h GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, coalesce(g.ctx, 'Aucun historique disponible.') AS contexte
FROM c LEFT JOIN g USING (conv_id, turn)"""

ORACLE["exact_sample"] = with_(PRODUCTS) + """
SELECT row_id, code, product_name FROM products
ORDER BY md5(concat(CAST(row_id AS VARCHAR), '42')), row_id LIMIT 500"""

ORACLE["split_80_20"] = with_(PRODUCTS) + """,
r AS (SELECT row_id, code,
        row_number() OVER (ORDER BY md5(concat(CAST(row_id AS VARCHAR), '1678807467440')), row_id) AS rn,
        count(*) OVER () AS n FROM products)
SELECT row_id, code, CASE WHEN rn <= floor(n * 0.8e0) THEN 'train' ELSE 'test' END AS "partition" FROM r"""


def _safe(expr: str) -> str:
    return (f"CASE WHEN {expr} IS NULL OR lower(trim({expr})) IN ('nan', '', 'null', 'none') "
            f"THEN '[DONNEE MANQUANTE]' ELSE {expr} END")


_DOC_COLS = [("code", False), ("product_name", False), ("brands_tags", False), ("categories_en", False),
             ("countries_en", False), ("ingredients_text", False), ("energy_100g", True), ("sugars_100g", True),
             ("saturated_fat_100g", True), ("fat_100g", True), ("salt_100g", True), ("sodium_100g", True),
             ("fiber_100g", True), ("proteins_100g", True), ("fruits_100g", True),
             ("nutrition_score_fr_100g", True), ("nutrition_grade_fr", False)]

DOCS = """
docs AS (
SELECT row_id, concat_ws(' | ', 'PRODUIT SOURCE', """ + ", ".join(
    f"'{c}: ' || " + _safe(f"CAST(CAST({c} AS DOUBLE) AS VARCHAR)" if num else f"CAST({c} AS VARCHAR)")
    for c, num in _DOC_COLS) + """) AS page_content,
  'openfoodfacts' AS source, coalesce(product_name, '') AS meta_product_name, coalesce(code, '') AS meta_code
FROM products)"""

ORACLE["product_text"] = with_(PRODUCTS, DOCS) + "SELECT * FROM docs"

ORACLE["valid_reference"] = with_(PRODUCTS) + """
SELECT row_id, lower(product_name) AS product_name, categories_en FROM products
WHERE product_name IS NOT NULL AND categories_en IS NOT NULL AND length(product_name) > 0
  AND length(categories_en) > 0"""

ORACLE["tsv_scan"] = with_(PRODUCTS) + """
SELECT CAST(row_id AS VARCHAR) AS row_id, lower(product_name) AS product_name, categories_en FROM products
WHERE product_name IS NOT NULL AND categories_en IS NOT NULL AND length(product_name) > 0
  AND length(categories_en) > 0"""

# --- text similarity ----------------------------------------------------------------


def _stop_words_sql() -> str:
    import os
    path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "resources", "stopwords_en.txt")
    with open(path, encoding="utf-8") as fh:
        words = [w.strip() for w in fh if w.strip() and not w.startswith("#")]
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


TFIDF = f"""
docs_t AS (
SELECT row_id, concat_ws(' ', coalesce(product_name, ''), coalesce(categories_en, ''),
                         coalesce(ingredients_text, ''), coalesce(brands_tags, '')) AS text FROM products),
toks AS (SELECT row_id, unnest(regexp_extract_all(lower(text), '\\b\\w\\w+\\b')) AS term FROM docs_t),
tf AS (SELECT row_id, term, count(*) AS tf FROM toks WHERE term NOT IN ({_stop_words_sql()}) GROUP BY row_id, term),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
nd AS (SELECT count(*) AS n FROM products),
wt AS (SELECT row_id, term, tf * (ln(CAST(1 + n AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1) AS w
       FROM tf JOIN dfq USING (term) CROSS JOIN nd),
nrm AS (SELECT row_id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY row_id),
vec AS (SELECT row_id, term, w / norm AS w FROM wt JOIN nrm USING (row_id))"""

SIM_TARGETS = """,
srefs AS (SELECT q_id, reference_deduite AS ref FROM qe
          WHERE intention IN ('similarite', 'categorie') AND reference_deduite <> ''),
sbc AS (SELECT q_id, min(row_id) AS code_row FROM srefs JOIN products ON trim(code) = ref GROUP BY q_id),
snm AS (SELECT q_id, min(row_id) AS name_row FROM srefs
        JOIN products ON contains(lower(product_name), lower(ref)) GROUP BY q_id),
targets AS (SELECT q_id AS tid, coalesce(code_row, name_row) AS doc FROM srefs
            LEFT JOIN sbc USING (q_id) LEFT JOIN snm USING (q_id)
            WHERE coalesce(code_row, name_row) IS NOT NULL)"""

ALL_TARGETS = """,
targets AS (SELECT row_id AS tid, row_id AS doc FROM products)"""


def _topk_sql(better_only: bool) -> str:
    better = "AND (tm.trank IS NULL OR cm.crank < tm.trank)" if better_only else ""
    return f""",
tm AS (SELECT tid, doc, trim(p.code) AS tcode,
         CASE lower(trim(p.nutrition_grade_fr)) WHEN 'a' THEN 0 WHEN 'b' THEN 1 WHEN 'c' THEN 2 WHEN 'd' THEN 3
              WHEN 'e' THEN 4 END AS trank
       FROM targets JOIN products p ON p.row_id = doc),
cm AS (SELECT row_id AS cand, trim(code) AS ccode,
         coalesce(CASE lower(nutrition_grade_fr) WHEN 'a' THEN 0 WHEN 'b' THEN 1 WHEN 'c' THEN 2 WHEN 'd' THEN 3
                  WHEN 'e' THEN 4 END, 99) AS crank,
         nutrition_score_fr_100g AS score FROM products),
sims AS (SELECT t.tid, v2.row_id AS cand, sum(v1.w * v2.w) AS sim
         FROM targets t JOIN vec v1 ON v1.row_id = t.doc JOIN vec v2 ON v2.term = v1.term GROUP BY t.tid, v2.row_id),
pairs AS (SELECT tm.tid, cm.cand, round(coalesce(s.sim, 0e0), 9) AS sim, cm.score
          FROM tm CROSS JOIN cm LEFT JOIN sims s ON s.tid = tm.tid AND s.cand = cm.cand
          WHERE (cm.ccode IS NULL OR tm.tcode IS NULL OR cm.ccode <> tm.tcode) {better}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY sim DESC, score ASC NULLS LAST, cand ASC) AS rnk
           FROM pairs)"""


ORACLE["similar_products"] = with_(PRODUCTS, QUESTIONS, TFIDF) + SIM_TARGETS + _topk_sql(False) + """
SELECT tid AS q_id, CAST(rnk AS INTEGER) AS rank, cand AS row_id, p.product_name, p.nutrition_grade_fr,
       sim AS similarite
FROM ranked JOIN products p ON p.row_id = cand WHERE rnk <= 5"""

ORACLE["better_rated"] = with_(PRODUCTS, QUESTIONS, TFIDF) + SIM_TARGETS + _topk_sql(True) + """
SELECT tid AS q_id, CAST(rnk AS INTEGER) AS rank, cand AS row_id, p.product_name, p.nutrition_grade_fr,
       sim AS similarite
FROM ranked JOIN products p ON p.row_id = cand WHERE rnk <= 5"""

ORACLE["similar_all_pairs"] = with_(PRODUCTS, TFIDF) + ALL_TARGETS + _topk_sql(False) + """
SELECT tid AS target_row_id, CAST(rnk AS INTEGER) AS rank, cand AS row_id, sim AS similarite
FROM ranked WHERE rnk <= 5"""

ORACLE["category_vote"] = with_(PRODUCTS, QUESTIONS, TFIDF) + SIM_TARGETS + _topk_sql(False) + """,
sim5 AS (SELECT tid AS q_id, rnk, cand FROM ranked WHERE rnk <= 5),
parts AS (SELECT q_id, rnk, string_split(coalesce(p.categories_en, ''), ',') AS cs
          FROM sim5 JOIN products p ON p.row_id = cand),
cats AS (SELECT q_id, rnk, trim(unnest(cs)) AS c, unnest(range(len(cs))) AS i FROM parts),
cnt AS (SELECT q_id, c, count(*) AS n, min(rnk * 100000 + i) AS fs FROM cats
        WHERE c <> '' AND lower(c) NOT IN ('null', 'undefined') GROUP BY q_id, c),
top3 AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY n DESC, fs ASC) AS pos FROM cnt),
agg AS (SELECT q_id, string_agg(c || ':' || CAST(n AS VARCHAR), '; ' ORDER BY pos) AS prev,
               min_by(c, pos) AS first_c FROM top3 WHERE pos <= 3 GROUP BY q_id)
SELECT q.q_id, coalesce(first_c, 'Categorie indeterminee') AS categorie_suggeree,
       coalesce(prev, '') AS categories_preuves
FROM (SELECT DISTINCT q_id FROM sim5) q LEFT JOIN agg USING (q_id)"""

ORACLE["text_pair_similarity"] = with_(PRODUCTS) + """,
t AS (SELECT row_id, regexp_extract_all(lower(coalesce(product_name, '')), '\\b\\w\\w+\\b') AS ta,
             regexp_extract_all(lower(coalesce(ingredients_text, '')), '\\b\\w\\w+\\b') AS tb FROM products),
tfa AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(ta) AS term FROM t) GROUP BY row_id, term),
tfb AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(tb) AS term FROM t) GROUP BY row_id, term),
j AS (SELECT coalesce(a.row_id, b.row_id) AS row_id, coalesce(a.tf, 0) AS fa, coalesce(b.tf, 0) AS fb
      FROM tfa a FULL OUTER JOIN tfb b ON a.row_id = b.row_id AND a.term = b.term),
w AS (SELECT row_id, fa * CASE WHEN fa > 0 AND fb > 0 THEN 1e0 ELSE ln(1.5e0) + 1e0 END AS wa,
             fb * CASE WHEN fa > 0 AND fb > 0 THEN 1e0 ELSE ln(1.5e0) + 1e0 END AS wb FROM j),
agg AS (SELECT row_id, sum(wa * wb) AS dot, sqrt(sum(wa * wa)) AS na, sqrt(sum(wb * wb)) AS nb
        FROM w GROUP BY row_id)
SELECT p.row_id, CASE WHEN agg.row_id IS NULL THEN NULL WHEN na = 0 OR nb = 0 THEN 0e0
                      ELSE round(dot / (na * nb), 3) END AS similarite
FROM products p LEFT JOIN agg USING (row_id)"""

# --- vectors -----------------------------------------------------------------------

VEC = """
ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
en AS (SELECT vec_id, v, label, sqrt(list_inner_product(v, v)) AS nrm FROM ev),
vq AS (SELECT * FROM en WHERE vec_id % 5 = 0),
vr AS (SELECT * FROM en WHERE vec_id % 5 <> 0),
vs AS (SELECT vq.vec_id AS qid, vr.vec_id AS rid, vr.label,
              round(list_inner_product(vq.v, vr.v) / (vq.nrm * vr.nrm), 6) AS score FROM vq CROSS JOIN vr),
vb AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS rk FROM vs)"""

ORACLE["knn_exact"] = with_(VEC) + """
SELECT qid AS vec_id, rid AS neighbour_id, score, label AS neighbour_label FROM vb WHERE rk = 1"""

# the inverted-file search is exact, with more cells than first probes too
ORACLE["knn_ivf"] = ORACLE["knn_exact"]

ORACLE["retrieve_topk"] = with_(VEC) + """
SELECT qid AS vec_id, CAST(rk AS INTEGER) AS rank, rid AS neighbour_id, score FROM vb WHERE rk <= 5"""

ORACLE["knn_saved_index"] = ORACLE["retrieve_topk"]

# --- text vectors: the hashed 3-grams of the embedding, murmur3 worked out in SQL -------

M32 = 4294967296


def _mixed(column: str, source: str, steps: list[str]) -> str:
    """Nested SELECTs that apply ``steps`` (over {x}) to a column, each on the value before it."""
    for step in steps:
        source = f"(SELECT * REPLACE ({step.replace('{x}', column)} AS {column}) FROM {source})"
    return source


def _mix_block(x: str) -> list[str]:
    return [f"({x} * 3432918353) % {M32}", f"({x} * 32768) % {M32} + {x} // 131072", f"({x} * 461845907) % {M32}"]


def hashed_vectors(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name`` (key, bucket, w): L2-normalised counts of the 3-grams of lower(text) in 256 buckets."""
    listed = "k"
    for step in _mix_block("x"):
        listed = f"list_transform({listed}, lambda x: {step})"
    tail = _mixed("tail", f"{name}_b", _mix_block("{x}"))
    final = _mixed("h", f"{name}_h", ["xor({x}, n::HUGEINT)", "xor({x}, {x} // 65536)", f"({{x}} * 2246822507) % {M32}", "xor({x}, {x} // 8192)",
                                      f"({{x}} * 3266489909) % {M32}", "xor({x}, {x} // 65536)"])
    return f"""
{name}_g AS (SELECT key, substr(t, i, 1) || ' ' || substr(t, i + 1, 1) || ' ' || substr(t, i + 2, 1) AS gram
             FROM (SELECT key, t, unnest(range(1, length(t) - 1)) AS i FROM (SELECT {key} AS key, lower(coalesce({text}, '')) AS t FROM {source}))),
{name}_a AS (SELECT gram, list_transform(regexp_extract_all(hex(encode(gram)), '..'), lambda x: CAST('0x' || x AS HUGEINT)) AS b
             FROM (SELECT DISTINCT gram FROM {name}_g)),
{name}_b AS (SELECT gram, len(b) AS n, list_transform(range(0, len(b) // 4), lambda i: b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216) AS k,
                    coalesce(CASE WHEN len(b) % 4 > 0 THEN b[len(b) // 4 * 4 + 1] END, 0::HUGEINT) + coalesce(CASE WHEN len(b) % 4 > 1 THEN b[len(b) // 4 * 4 + 2] END, 0::HUGEINT) * 256
                    + coalesce(CASE WHEN len(b) % 4 > 2 THEN b[len(b) // 4 * 4 + 3] END, 0::HUGEINT) * 65536 AS tail FROM {name}_a),
{name}_h AS (SELECT gram, n, xor(list_reduce(list_prepend(42::HUGEINT, {listed}),
                    lambda h, x: (((xor(h, x) * 8192) % {M32} + xor(h, x) // 524288) * 5 + 3864292196) % {M32}), tail) AS h FROM {tail}),
{name}_n AS (SELECT key, CAST(h % 256 AS INTEGER) AS bucket, count(*) AS c FROM {name}_g JOIN {final} USING (gram) GROUP BY ALL),
{name} AS (SELECT key, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY key)) AS w FROM {name}_n)"""


def filled_names(name: str, todo: str, reference: str, value: str) -> str:
    """CTE ``name`` (qid, score, value): the nearest reference name of each name in ``todo`` (qid, name); equal names are compared once."""
    return hashed_vectors(f"{name}_q", f"(SELECT DISTINCT name FROM {todo})", "name", "name") + "," + \
        hashed_vectors(f"{name}_r", f"(SELECT DISTINCT name FROM {reference})", "name", "name") + f""",
{name}_s AS (SELECT q.key AS qname, r.key AS rname, round(sum(q.w * r.w), 6) AS score FROM {name}_q q JOIN {name}_r r USING (bucket) GROUP BY ALL),
{name}_o AS (SELECT qid, score, {value} AS value, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS rk
             FROM {todo} t JOIN {name}_s s ON t.name = s.qname JOIN {reference} r ON r.name = s.rname),
{name} AS (SELECT qid, score, value FROM {name}_o WHERE rk = 1)"""


FILLED = """
ref AS (SELECT row_id AS rid, lower(product_name) AS name, categories_en FROM products
        WHERE product_name IS NOT NULL AND categories_en IS NOT NULL AND length(product_name) > 0 AND length(categories_en) > 0),
todo AS (SELECT row_id AS qid, lower(product_name) AS name FROM products
         WHERE (categories_en IS NULL OR trim(categories_en) = '') AND product_name IS NOT NULL)""" + "," + \
    filled_names("near", "todo", "ref", "categories_en") + """,
filled AS (SELECT row_id, code, product_name,
  CASE WHEN categories_en IS NULL OR trim(categories_en) = '' THEN CASE WHEN score >= 0.55e0 THEN value ELSE '' END ELSE categories_en END AS categories_en,
  categories_en IS NULL OR trim(categories_en) = '' AS to_complete,
  (categories_en IS NULL OR trim(categories_en) = '') AND score IS NOT NULL AND score >= 0.55e0 AS completed, score
  FROM products LEFT JOIN near ON near.qid = products.row_id)"""

ORACLE["impute_categories"] = with_(PRODUCTS, FILLED) + "SELECT * FROM filled"

ORACLE["impute_categories_report"] = with_(PRODUCTS, FILLED) + """
SELECT count(*) FILTER (WHERE to_complete) AS to_complete, count(*) FILTER (WHERE completed) AS completed,
       count(*) FILTER (WHERE completed) * 1e2 / nullif(count(*) FILTER (WHERE to_complete), 0) AS pct_completed
FROM filled"""

ORACLE["impute_chain"] = with_(PRODUCTS, FILLED) + """,
lab AS (SELECT p_partkey AS rid, lower(CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_name END) AS name,
               CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN ''
                    ELSE 'en:' || lower(p_type) || ',en:' || lower(replace(p_brand, '#', '-')) END AS labels_tags FROM part),
lref AS (SELECT * FROM lab WHERE name IS NOT NULL AND labels_tags IS NOT NULL AND length(name) > 0 AND length(labels_tags) > 0),
ltodo AS (SELECT row_id AS qid, lower(product_name) AS name FROM filled WHERE product_name IS NOT NULL)""" + "," + \
    filled_names("lnear", "ltodo", "lref", "labels_tags") + """
SELECT row_id, code, product_name, nullif(categories_en, '') AS categories_en, CASE WHEN l.score >= 0.55e0 THEN l.value END AS labels_tags
FROM filled LEFT JOIN lnear l ON l.qid = filled.row_id"""

ORACLE["document_retrieval"] = with_(PRODUCTS, QUESTIONS, DOCS) + """,
asked AS (SELECT q_id, concat_ws(' ', question, indice_produit) AS asked FROM questions_t)""" + "," + \
    hashed_vectors("dq", "(SELECT DISTINCT asked FROM asked)", "asked", "asked") + "," + hashed_vectors("dd", "docs", "row_id", "page_content") + """,
ds AS (SELECT q.key AS asked, d.key AS row_id, round(sum(q.w * d.w), 6) AS score FROM dq q JOIN dd d USING (bucket) GROUP BY ALL),
dr AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, row_id) AS rk FROM ds),
dc AS (SELECT asked, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY rk) AS documents, string_agg(page_content, chr(10) || chr(10) ORDER BY rk) AS contexte
       FROM dr JOIN docs USING (row_id) WHERE rk <= 5 GROUP BY asked)
SELECT q_id, coalesce(documents, '') AS documents, coalesce(contexte, 'Aucune information trouvée dans le dataset.') AS contexte
FROM asked LEFT JOIN dc USING (asked)"""

IMPUTE = """,
best AS (SELECT qid, score, label AS nl FROM vb WHERE rk = 1),
imp AS (
SELECT e.vec_id,
  CASE WHEN e.vec_id % 5 = 0 THEN (CASE WHEN b.score >= 0.35e0 THEN coalesce(CAST(b.nl AS VARCHAR), '') ELSE '' END)
       ELSE CAST(e.label AS VARCHAR) END AS label_completed,
  e.vec_id % 5 = 0 AS to_complete,
  e.vec_id % 5 = 0 AND b.score IS NOT NULL AND b.score >= 0.35e0 AS completed,
  CASE WHEN e.vec_id % 5 = 0 THEN b.score END AS score
FROM embeddings e LEFT JOIN best b ON b.qid = e.vec_id)"""

ORACLE["impute_labels"] = with_(VEC) + IMPUTE + "SELECT * FROM imp"

ORACLE["completion_report"] = with_(VEC) + IMPUTE + """
SELECT count(*) FILTER (WHERE to_complete) AS to_complete, count(*) FILTER (WHERE completed) AS completed,
  CASE WHEN count(*) FILTER (WHERE to_complete) = 0 THEN NULL
       ELSE count(*) FILTER (WHERE completed) * 100.0e0 / count(*) FILTER (WHERE to_complete) END AS pct_completed
FROM imp"""

# --- streams (the stream result equals the batch form) --------------------------------

ORACLE["question_stream"] = with_(QUESTIONS) + """
SELECT q_id, question, intention, codebarres_effectif, code_additif FROM qe"""

ORACLE["scan_stream"] = with_(PRODUCTS, EXTERNAL) + SCAN.replace("FROM external)", "FROM external)", 1) + """,
npart AS (SELECT count(*) AS n FROM part),
scans AS (SELECT event_id, ts, CAST(3000000000000 + (event_id % n + n) % n AS VARCHAR) AS code FROM events, npart)
SELECT s.event_id, s.ts, s.code,
  CASE WHEN sc.code IS NULL THEN 'Inconnu' WHEN sc.product_name IS NULL OR sc.product_name = '' THEN 'Inconnu'
       ELSE sc.product_name END AS product_name,
  CASE WHEN sc.code IS NULL THEN 'Inconnu' WHEN sc.brands IS NULL OR sc.brands = '' THEN 'Inconnu'
       ELSE sc.brands END AS brands,
  CASE WHEN sc.code IS NULL THEN 'B'
       WHEN sc.score_numerique <= -1 THEN 'A' WHEN sc.score_numerique <= 2 THEN 'B'
       WHEN sc.score_numerique <= 10 THEN 'C' WHEN sc.score_numerique <= 18 THEN 'D' ELSE 'E' END
    AS nutriscore_predit,
  CASE WHEN sc.nutrition_grades IS NULL OR sc.nutrition_grades = '' THEN 'Non disponible'
       ELSE sc.nutrition_grades END AS nutriscore_officiel,
  coalesce(sc.score_numerique, 0) AS score_numerique,
  coalesce(sc.fat, 0e0) AS fat, coalesce(sc.sugar, 0e0) AS sugar, coalesce(sc.salt, 0e0) AS salt,
  coalesce(sc.prot, 0e0) AS proteins, coalesce(sc.fiber, 0e0) AS fiber, coalesce(sc.energy, 0e0) AS energy_kj,
  coalesce(sc.sat, 0e0) AS sat_fat, coalesce(sc.fruits, 0e0) AS fruits_veg,
  CASE WHEN sc.image_front_url IS NOT NULL AND sc.image_front_url <> '' THEN sc.image_front_url
       WHEN sc.image_url IS NOT NULL AND sc.image_url <> '' THEN sc.image_url END AS image_url,
  CASE WHEN sc.code IS NULL THEN 'Produit introuvable sur Open Food Facts.' END AS erreur
FROM scans s LEFT JOIN sc ON sc.code = trim(s.code)"""

# --- retrieval context and SQL guard ----------------------------------------------------


def _tfidf_corpus(corpus_cte: str) -> str:
    return f"""{corpus_cte},
ctoks AS (SELECT key, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}')) AS term FROM corpus),
ctf AS (SELECT key, term, count(*) AS tf FROM ctoks WHERE term NOT IN ({_stop_words_sql()}) GROUP BY key, term),
cdf AS (SELECT term, count(*) AS df FROM ctf GROUP BY term),
cn AS (SELECT count(*) AS n FROM corpus),
cw AS (SELECT key, term, tf * (ln(CAST(1 + n AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1) AS w
       FROM ctf JOIN cdf USING (term) CROSS JOIN cn),
cnrm AS (SELECT key, sqrt(sum(w * w)) AS norm FROM cw GROUP BY key),
cvec AS (SELECT key, term, w / norm AS w FROM cw JOIN cnrm USING (key))"""


ORACLE["context_join"] = with_(PRODUCTS, QUESTIONS, DOCS) + ",\n" + _tfidf_corpus("""
corpus AS (SELECT -(q_id + 1) AS key, question AS text FROM questions_t
           UNION ALL SELECT row_id, page_content FROM docs)""") + """,
qs AS (SELECT q_id, -(q_id + 1) AS key FROM questions_t),
ss AS (SELECT qs.q_id, v2.key AS doc, sum(v1.w * v2.w) AS sim
       FROM qs JOIN cvec v1 ON v1.key = qs.key JOIN cvec v2 ON v2.term = v1.term AND v2.key >= 0
       GROUP BY qs.q_id, v2.key),
pairs AS (SELECT qs.q_id, d.row_id AS doc, round(coalesce(ss.sim, 0e0), 9) AS sim
          FROM qs CROSS JOIN docs d LEFT JOIN ss ON ss.q_id = qs.q_id AND ss.doc = d.row_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, doc ASC) AS r FROM pairs)
SELECT rk.q_id, string_agg(d.page_content, chr(10) || chr(10) ORDER BY r) AS contexte_rag
FROM rk JOIN docs d ON d.row_id = rk.doc WHERE r <= 4 GROUP BY rk.q_id"""

ORACLE["sql_guard"] = with_(PRODUCTS) + """
SELECT code, product_name, countries_en FROM products
WHERE countries_en IS NULL OR trim(countries_en) = '' OR lower(trim(countries_en)) IN ('nan', 'null', 'none')"""

ORACLE["cached_table"] = with_(PRODUCTS) + """
SELECT step, count(*) AS n_rows, CAST(sum(row_id) AS BIGINT) AS row_ids, count(product_name) AS n_names
FROM products, (VALUES ('made'), ('kept'), ('kept after a failed replacement'), ('replaced')) s(step)
WHERE step <> 'replaced' OR product_name IS NOT NULL GROUP BY step"""

ORACLE["csv_round_trip"] = with_(PRODUCTS) + """
SELECT * REPLACE (coalesce(product_name, '') AS product_name, coalesce(brands_tags, '') AS brands_tags, coalesce(categories_en, '') AS categories_en,
  coalesce(countries_en, '') AS countries_en, coalesce(nutrition_grade_fr, '') AS nutrition_grade_fr) FROM products"""

ORACLE["csv_head"] = with_(PRODUCTS) + "SELECT code, product_name, categories_en FROM products ORDER BY code LIMIT 500"

# --- the answers, one branch an intent ----------------------------------------------------

ANSWERED = ",\nctx AS (SELECT * FROM (" + ORACLE["context_join"] + "))," + """
fq AS (SELECT q_id, row_id AS j5_row FROM (""" + ORACLE["resolve_question"] + """)),
coh AS (SELECT row_id, message FROM (""" + ORACLE["grade_coherence"] + """)),
refs AS (SELECT q_id, reference_deduite AS ref FROM qe WHERE reference_deduite <> ''),
cands AS (SELECT q_id, row_id, code, product_name, row_number() OVER (PARTITION BY q_id ORDER BY row_id) AS pos
          FROM refs JOIN products ON trim(code) = ref OR lower(product_name) LIKE lower('%' || ref || '%')),
cagg AS (SELECT q_id, count(*) AS n_cand, min(row_id) AS first_cand,
                '[' || string_agg('{''code'': ''' || code || ''', ''product_name'': ''' || coalesce(product_name, '') || '''}', ', ' ORDER BY pos) || ']' AS listed
         FROM cands WHERE pos <= 5 GROUP BY q_id),
st AS (SELECT qe.*, coalesce(n_cand, 0) AS n_cand, listed, CASE WHEN n_cand = 1 THEN first_cand ELSE j5_row END AS local_row
       FROM qe LEFT JOIN cagg USING (q_id) LEFT JOIN fq USING (q_id)),
lo AS (SELECT st.*, p.row_id IS NOT NULL AS has_local, p.product_name AS l_name,
              coalesce(CASE WHEN trim(codebarres_effectif) <> '' THEN codebarres_effectif END, CASE WHEN trim(p.code) <> '' THEN trim(p.code) END) AS code_eff,
              CASE WHEN indice_produit <> '' THEN indice_produit WHEN p.row_id IS NOT NULL THEN coalesce(p.product_name, '') ELSE '' END AS ref2
       FROM st LEFT JOIN products p ON p.row_id = st.local_row),
ex AS (SELECT lo.*, e.code IS NOT NULL AS has_ext, contexte_rag,
              coalesce(CASE WHEN e.countries <> '' THEN e.countries END, CASE WHEN len(e.countries_tags) > 0 THEN array_to_string(e.countries_tags, ', ') END, '') AS country,
              coalesce(code_additif, 'E' || nullif(regexp_extract(upper(contexte_rag), '\\bE\\s?([0-9]{3,4}[a-z]?)\\b', 1), ''), 'E330') AS add_code
       FROM lo LEFT JOIN external e ON e.code = lo.code_eff LEFT JOIN ctx USING (q_id)),
ar AS (SELECT q_id, intention, ref2 AS ref FROM ex WHERE intention IN ('categorie', 'similarite') AND ref2 <> ''),
ac AS (SELECT q_id, min(row_id) AS code_row FROM ar JOIN products ON trim(code) = trim(ref) GROUP BY q_id),
an AS (SELECT q_id, min(row_id) AS name_row FROM ar JOIN products ON contains(lower(product_name), lower(ref)) GROUP BY q_id),
tg AS (SELECT q_id, intention, coalesce(code_row, name_row) AS doc FROM ar LEFT JOIN ac USING (q_id) LEFT JOIN an USING (q_id) WHERE coalesce(code_row, name_row) IS NOT NULL),
cat5 AS (WITH targets AS (SELECT q_id AS tid, doc FROM tg WHERE intention = 'categorie')""" + _topk_sql(False) + """
         SELECT tid AS q_id, rnk, cand FROM ranked WHERE rnk <= 5),
sim5 AS (WITH targets AS (SELECT q_id AS tid, doc FROM tg WHERE intention = 'similarite')""" + _topk_sql(True) + """
         SELECT tid AS q_id, rnk, cand, sim FROM ranked WHERE rnk <= 5),
ln AS (SELECT q_id, string_agg(coalesce(product_name, '') || ' (Nutri-Score ' || upper(coalesce(nutrition_grade_fr, '')) || ', similarite='
                               || CAST(round(sim, 3) AS VARCHAR) || ')', '; ' ORDER BY rnk) AS similar_lines FROM sim5 JOIN products ON row_id = cand GROUP BY q_id),
vp AS (SELECT q_id, rnk, string_split(coalesce(p.categories_en, ''), ',') AS cs FROM cat5 JOIN products p ON p.row_id = cand),
vc AS (SELECT q_id, rnk, trim(unnest(cs)) AS c, unnest(range(len(cs))) AS i FROM vp),
vn AS (SELECT q_id, c, count(*) AS n, min(rnk * 100000 + i) AS fs FROM vc WHERE c <> '' AND lower(c) NOT IN ('null', 'undefined') GROUP BY q_id, c),
v3 AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY n DESC, fs ASC) AS pos FROM vn),
vo AS (SELECT q_id, min_by(c, pos) AS suggested, '[' || string_agg('(''' || c || ''', ' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY pos) || ']' AS proof
       FROM v3 WHERE pos <= 3 GROUP BY q_id),
e5 AS (SELECT '[' || string_agg('''' || coalesce(product_name, '') || '''', ', ' ORDER BY row_id) || ']' AS examples
       FROM (SELECT row_id, product_name FROM todo ORDER BY row_id LIMIT 5)),
x AS (SELECT q_id, add_code AS code_additif FROM ex),
sh AS (SELECT x.q_id, """ + ADDITIVE_SHEET + """ FROM x LEFT JOIN additives_t a ON a.code = x.code_additif),
al AS (SELECT ex.*, examples, similar_lines, coalesce(suggested, 'Categorie indeterminee') AS suggested, coalesce(proof, '[]') AS proof, nom, role, description, source_nom, url_source,
              ref2 = '' AS no_ref, coalesce(e.grade_estime, 'b') AS grade_estime, coalesce(e.score_estime, 0e0) AS score_estime,
              coalesce(e.justification, 'Estimation heuristique basee sur les nutriments disponibles : . Score estime = 0.0.') AS justification,
              CASE WHEN has_local THEN c.message ELSE 'Informations produit manquantes.' END AS message,
              CASE WHEN has_ext AND country <> '' THEN country ELSE 'information non trouvee' END AS pays,
              CASE WHEN has_local THEN coalesce(l_name, '') ELSE 'ce produit' END AS est_name
       FROM ex CROSS JOIN e5 LEFT JOIN ln USING (q_id) LEFT JOIN vo USING (q_id) LEFT JOIN sh USING (q_id)
            LEFT JOIN est2 e ON e.row_id = local_row LEFT JOIN coh c ON c.row_id = local_row),
said AS (SELECT q_id, question, intention,
  CASE intention
    WHEN 'additif' THEN add_code || ' correspond a ' || nom || '. Son role principal est : ' || role || '. ' || description
    WHEN 'categorie' THEN CASE WHEN no_ref AND n_cand > 1 THEN 'Plusieurs produits correspondent a la demande, je ne peux pas proposer une categorie unique sans precision.'
      WHEN no_ref THEN 'Je n''ai pas trouve de produit cible explicite pour proposer une categorie.'
      ELSE 'Pour ' || CASE WHEN has_local THEN coalesce(l_name, '') ELSE ref2 END || ', la categorie la plus plausible est : ' || suggested || '.' END
    WHEN 'origine' THEN CASE WHEN code_eff IS NOT NULL THEN 'Le code-barres ' || code_eff || ' renvoie le pays d''origine suivant : ' || pays || '.'
      ELSE 'Aucun code-barres explicite n''a ete detecte dans la question.' END
    WHEN 'similarite' THEN CASE WHEN no_ref AND n_cand > 1 THEN 'Je detecte plusieurs produits possibles, donc je ne peux pas calculer une similarite ciblee sans precision.'
      WHEN no_ref THEN 'Je n''ai pas trouve de produit de reference pour la recherche de similarite.'
      WHEN similar_lines IS NOT NULL THEN 'Produits similaires mieux notes trouves : ' || similar_lines ELSE 'Aucun produit similaire mieux note n''a ete trouve.' END
    WHEN 'coherence' THEN message
    WHEN 'estimer_nutriscore' THEN 'Pour ' || est_name || ', le Nutri-Score estime est ' || upper(grade_estime) || ' (score ' || CAST(score_estime AS VARCHAR) || ').'
    ELSE 'Voici la meilleure synthese disponible a partir du contexte local.' END AS a,
  CASE intention
    WHEN 'additif' THEN 'Ajouter une fiche additif structuree avec code, nom, role et source fiable. Source retenue : ' || source_nom || ' (' || url_source || ').'
    WHEN 'categorie' THEN CASE WHEN no_ref AND n_cand > 1 THEN 'Preciser le code-barres ou le nom exact du produit parmi les candidats proposes.'
      WHEN no_ref THEN 'Fournir un nom produit ou un code-barres.' ELSE 'Renseigner le champ categories_en avec ' || suggested || ' puis demander une validation humaine.' END
    WHEN 'origine' THEN CASE WHEN code_eff IS NOT NULL THEN 'Completer le champ countries_en avec la valeur retournee par l''API Open Food Facts si elle est validee.'
      ELSE 'Fournir un code-barres ou un produit cible pour completer le pays d''origine via l''API Open Food Facts.' END
    WHEN 'similarite' THEN CASE WHEN no_ref AND n_cand > 1 THEN 'Donner le code-barres exact du produit a comparer.' WHEN no_ref THEN 'Fournir un nom de produit ou un code-barres.'
      ELSE 'Ajouter au produit courant une liste de recommandations alternatives mieux notees.' END
    WHEN 'coherence' THEN 'Conserver le Nutri-Score actuel s''il est coherent, sinon signaler une verification manuelle.'
    WHEN 'estimer_nutriscore' THEN 'Ajouter le Nutri-Score estime comme proposition d''enrichissement en attendant validation humaine.'
    ELSE 'Enrichir le produit avec les champs manquants identifies dans le contexte.' END AS b,
  CASE intention
    WHEN 'additif' THEN 'La reponse s''appuie sur la fiche locale de l''additif et sur une source externe referencee : ' || url_source || '.'
    WHEN 'categorie' THEN CASE WHEN no_ref AND n_cand > 1 THEN 'Ambiguite detectee en SQL local: ' || listed WHEN no_ref THEN 'Aucune reference exploitable dans la question.'
      ELSE 'La proposition vient des produits les plus proches dans la base, dont les categories dominantes sont : ' || proof || '.' END
    WHEN 'origine' THEN CASE WHEN code_eff IS NOT NULL THEN 'Le pays provient de l''API Open Food Facts interrogee a partir du code-barres.'
      ELSE 'Exemples locaux de produits a completer : ' || examples END
    WHEN 'similarite' THEN CASE WHEN no_ref AND n_cand > 1 THEN 'Ambiguite detectee en SQL local: ' || listed WHEN no_ref THEN 'Aucune reference exploitable dans la question.'
      ELSE 'La similarite est calculee sur le nom, la categorie, les ingredients et la marque via TF-IDF.' END
    WHEN 'coherence' THEN CASE WHEN has_local OR has_ext THEN justification ELSE 'Comparaison realisee a partir des nutriments disponibles.' END
    WHEN 'estimer_nutriscore' THEN justification
    ELSE coalesce(CASE WHEN trim(contexte_rag) <> '' THEN contexte_rag END, 'Aucun contexte local supplementaire disponible.') END AS c
  FROM al)"""

ORACLE["api_responses"] = with_(PRODUCTS, QUESTIONS, EXTERNAL, ESTIMATE, ADDITIVES_SQL, TFIDF, MISSING_COUNTRY) + ANSWERED + """
SELECT 'Réponse' || chr(10) || a || chr(10) || chr(10) || 'Proposition d''enrichissement' || chr(10) || b || chr(10) || chr(10) || 'Justification' || chr(10) || c AS response,
       intention AS intent, question FROM said"""

