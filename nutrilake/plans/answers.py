"""Q9: answer every question of the question table in one job.

The reference answers one question at a time through a step loop; here
each step is a bulk join keyed by the question id:

1. intent (F21), barcode (F19), deduced reference (F22);
2. SQL-style candidates for the reference (P10, 5); exactly one -> local product;
3. otherwise local resolution from barcode / hint / quoted texts (J5);
4. product reference source by barcode or local code (J7); retrieval of the
   4 closest product documents as context (L4 + F4, TF-IDF cosine);
5. products without a country as examples for ``origine`` questions (P7);
6. one analysis branch per intent (F28) -> JSON payload (F26) -> answer
   text (F27).

The chat-model call of the reference is not built: the answer is its
deterministic fallback text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nutrilake.functions import nutrition as N
from nutrilake.operators import lookup, textsim
from nutrilake.operators.memory import summary
from nutrilake.plans import misc, similar
from nutrilake.plans.lookups import questions_enriched, resolve_question_df, resolve_reference_df, sql_candidates
from nutrilake.session import materialize
from nutrilake.sources import tables

CONTEXT_DOCS = 4
NO_CONTEXT = "Aucune information trouvée dans le dataset."
DEFAULT_ADDITIVE = "E330"
EXAMPLES = 5


def _nb(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def _py_str(c: Column) -> Column:
    """Python repr of a text inside a list; a missing text was loaded as ''."""
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    single, double = F.contains(c, F.lit("'")), F.contains(c, F.lit('"'))
    return F.when(single & ~double, F.concat(F.lit('"'), c, F.lit('"'))) \
        .otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'")))


def retrieval_context(spark: SparkSession, q: DataFrame, docs: DataFrame, k: int = CONTEXT_DOCS) -> DataFrame:
    """L4 + F4: the k product documents closest to each question (TF-IDF
    cosine over documents and questions), joined by a blank line."""
    qd = q.select((-(F.col("q_id") + 1)).alias("key"), F.col("question").alias("text"))
    dd = docs.select(F.col("row_id").alias("key"), F.col("page_content").alias("text"))
    vec = textsim.tfidf_fit(qd.unionByName(dd), "key", "text", textsim.load_stop_words()) \
        .withColumnRenamed("key", "doc")
    # Equal questions have equal contexts: one target a text.
    asked = materialize(q.groupBy("question").agg(F.min("q_id").alias("tid")))
    targets = asked.select("tid", (-(F.col("tid") + 1)).alias("doc"))
    others = qd.select(F.col("key").alias("doc")).join(targets.select("doc"), "doc", "left_anti")
    vec = vec.join(others, "doc", "left_anti")
    meta = docs.select(F.col("row_id").alias("doc"), F.lit(None).cast("string").alias("code"),
                       F.lit(None).cast("string").alias("grade"), F.lit(None).cast("int").alias("score"))
    top = textsim.top_k_similar(targets, vec, meta, k, False)
    ctx = (top.join(docs.select(F.col("row_id").alias("doc"), "page_content"), "doc")
           .groupBy("tid").agg(F.array_join(F.transform(
               F.array_sort(F.collect_list(F.struct("rank", "page_content"))), lambda x: x["page_content"]),
               "\n\n").alias("contexte_rag")))
    ctx = asked.join(ctx, "tid", "left").select(F.col("question").alias("_text"), "contexte_rag")
    return q.select("q_id", "question").join(ctx, F.col("question").eqNullSafe(F.col("_text")), "left") \
        .select("q_id", F.coalesce("contexte_rag", F.lit(NO_CONTEXT)).alias("contexte_rag"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.products(spark, sf_dir)
    pk = p.select("row_id", "code", "product_name")
    q = questions_enriched(spark, sf_dir)

    # step 1: SQL candidates; exactly one candidate is the local product
    refs = q.select("q_id", F.col("reference_deduite").alias("ref")).where(F.col("ref") != "")
    cands = sql_candidates(refs, pk).join(pk, "row_id")
    cagg = cands.groupBy("q_id").agg(
        F.count(F.lit(1)).alias("n_cand"), F.min_by("row_id", "pos").alias("first_cand"),
        F.array_sort(F.collect_list(F.struct("pos", "code", "product_name"))).alias("cand_list"))
    # step 2: local resolution when step 1 did not give one product
    j5 = resolve_question_df(q, pk).select("q_id", F.col("row_id").alias("j5_row"))
    s = (q.join(cagg, "q_id", "left").join(j5, "q_id", "left")
         .withColumn("n_cand", F.coalesce("n_cand", F.lit(0)))
         .withColumn("local_row", F.when(F.col("n_cand") == 1, F.col("first_cand")).otherwise(F.col("j5_row"))))
    local = p.select(*[F.col(c).alias("l_" + c) for c in p.columns])
    s = s.join(local, F.col("local_row") == F.col("l_row_id"), "left")
    has_local = F.col("l_row_id").isNotNull()

    # step 3: product reference source and retrieval context
    s = s.withColumn("code_eff", F.coalesce(_nb(F.col("codebarres_effectif")), _nb(F.trim(F.col("l_code")))))
    ext = tables.external_by_code(spark, sf_dir)
    ext = ext.select(*[F.col(c).alias("x_" + c) for c in ext.columns])
    s = s.join(ext, F.col("code_eff") == F.col("x_code"), "left")
    has_ext = F.col("x_code").isNotNull()
    s = s.join(retrieval_context(spark, q.select("q_id", "question"), misc.product_documents(p)), "q_id", "left")

    # step 4: products without a country (first 5 in file order; 5 rows, broadcast)
    examples = (misc.missing_country_rows(p).orderBy("row_id").limit(EXAMPLES)
                .agg(F.concat(F.lit("["), F.array_join(F.transform(
                    F.array_sort(F.collect_list(F.struct("row_id", "product_name"))),
                    lambda x: _py_str(x["product_name"])), ", "), F.lit("]")).alias("exemples"),
                    F.transform(F.array_sort(F.collect_list(F.struct("row_id", "code", "product_name", "countries_en"))),
                                lambda x: x.dropFields("row_id")).alias("exemples_liste")))
    # a single row: joined on a constant key as a bounded broadcast
    s = s.withColumn("_one", F.lit(1)).join(F.broadcast(examples.withColumn("_one", F.lit(1))), "_one").drop("_one")

    # references for the similarity intents: hint, else the local product's name
    s = s.withColumn("ref2", F.when(F.col("indice_produit").isNotNull() & (F.col("indice_produit") != ""),
                                    F.col("indice_produit"))
                     .otherwise(F.when(has_local, F.coalesce(F.col("l_product_name"), F.lit("")))
                                .otherwise(F.lit(""))))
    s = materialize(s)
    sim_refs = s.where(F.col("intention").isin("categorie", "similarite") & (F.col("ref2") != "")) \
        .select("q_id", "intention", F.col("ref2").alias("ref"))
    tgt = resolve_reference_df(sim_refs.select("q_id", "ref"), pk).where(F.col("row_id").isNotNull())
    vec, meta = similar.product_vectors(p), similar.product_meta(p)
    cat_t = tgt.join(sim_refs.where(F.col("intention") == "categorie").select("q_id"), "q_id") \
        .select(F.col("q_id").alias("tid"), F.col("row_id").alias("doc"))
    sim_t = tgt.join(sim_refs.where(F.col("intention") == "similarite").select("q_id"), "q_id") \
        .select(F.col("q_id").alias("tid"), F.col("row_id").alias("doc"))
    cat_top = textsim.top_k_similar(cat_t, vec, meta, 5, False)
    better = textsim.top_k_similar(sim_t, vec, meta, 5, True)
    votes = similar.vote_categories(cat_top.withColumnRenamed("tid", "q_id").withColumnRenamed("doc", "row_id"),
                                    p.select("row_id", "categories_en"))
    shown = p.select(F.col("row_id").alias("doc"), "code", "product_name", "categories_en", "nutrition_grade_fr")
    # The neighbours themselves are the evidence, for both intents
    near = (cat_top.unionByName(better).join(shown, "doc").groupBy(F.col("tid").alias("q_id"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct(
                "rank", "code", "product_name", "categories_en", "nutrition_grade_fr", "similarite"))),
                lambda x: x.dropFields("rank")).alias("voisins")))
    lines = F.array_join(F.transform("voisins", lambda x: F.concat(
        F.coalesce(x["product_name"], F.lit("")), F.lit(" (Nutri-Score "), F.upper(F.coalesce(x["nutrition_grade_fr"], F.lit(""))),
        F.lit(", similarite="), F.round(x["similarite"], 3).cast("string"), F.lit(")"))), "; ")
    s = s.join(votes, "q_id", "left").join(near, "q_id", "left").withColumn("similar_lines", lines)

    # analyses per intent
    s = _analyse(s, has_local, has_ext)
    payload = F.to_json(F.struct(
        F.col("intention"),
        F.when(has_local, F.struct(*[F.col("l_" + c).alias(c) for c in
                                     ("code", "product_name", "brands_tags", "categories_en", "countries_en",
                                      "nutrition_grade_fr", "nutrition_score_fr_100g")])).alias("produit_local"),
        F.when(F.col("code_eff").isNotNull(), F.struct(
            F.col("x_code").alias("code"), F.col("x_product_name").alias("product_name"),
            F.col("x_countries").alias("countries"), F.col("x_nutrition_grades").alias("nutrition_grades"),
            F.when(~has_ext, F.col("code_eff")).alias("codebarres"),
            F.when(~has_ext, F.lit("Produit introuvable sur Open Food Facts.")).alias("erreur")))
        .alias("produit_externe"),
        F.struct(F.col("a_reponse").alias("reponse"), F.col("a_enrichissement").alias("enrichissement"),
                 F.col("a_justification").alias("justification"), *_evidence(has_local | has_ext)).alias("analyse"),
        F.col("contexte_rag"),
        F.struct(F.col("reference_deduite").alias("reference"),
                 F.transform(F.coalesce("cand_list", F.array().cast("array<struct<pos:int,code:string,"
                                                                    "product_name:string>>")),
                             lambda x: F.struct(x["code"].alias("code"), x["product_name"].alias("product_name")))
                 .alias("candidats")).alias("contexte_sql"),
    ), {"ignoreNullFields": "false"})
    text = F.concat(F.lit("Réponse\n"), F.col("a_reponse"), F.lit("\n\nProposition d'enrichissement\n"),
                    F.col("a_enrichissement"), F.lit("\n\nJustification\n"), F.col("a_justification"))
    return s.select("q_id", "conv_id", "turn", "question", "intention", text.alias("reponse"),
                    payload.alias("charge_utile"), summary(F.col("a_reponse")).alias("resume"))


def _evidence(present: Column) -> list[Column]:
    """What each analysis rests on (F28, P18); fields of other intents are null."""
    it = F.col("intention")
    neighbours = it.isin("categorie", "similarite")
    no_ref = F.col("ref2") == ""
    estimate = F.struct(*[F.col("_e_" + c).alias(c) for c in ("grade_estime", "score_estime", "methode", "justification")])
    return [
        F.when(it == "additif", F.struct(F.col("add_code").alias("code"), "nom", "role", "description", "source_nom",
                                         "url_source")).alias("additif"),
        F.when(neighbours & no_ref & (F.col("n_cand") > 1),
               F.transform(F.slice("cand_list", 1, 5), lambda x: F.struct(x["code"].alias("code"), x["product_name"].alias("product_name"))))
        .alias("candidats_ambigus"),
        F.when((it == "categorie") & ~no_ref, F.coalesce("categorie_suggeree", F.lit("Categorie indeterminee"))).alias("categorie_suggeree"),
        F.when((it == "categorie") & ~no_ref, F.coalesce("categories_liste", F.array().cast("array<struct<categorie:string,n:bigint>>")))
        .alias("categories_preuves"),
        F.when(neighbours & ~no_ref, F.coalesce("voisins", F.array().cast(NEIGHBOURS))).alias("produits_similaires"),
        F.when((it == "origine") & F.col("code_eff").isNotNull(),
               F.struct(F.col("code_eff").alias("codebarres"), F.when(F.col("x_code").isNotNull(), F.col("a_pays")).alias("pays"),
                        F.when(F.col("x_code").isNull(), F.lit("Produit introuvable sur Open Food Facts.")).alias("erreur")))
        .alias("origine"),
        F.when((it == "origine") & F.col("code_eff").isNull(), F.col("exemples_liste")).alias("exemples_sans_pays"),
        F.when(it == "coherence", F.struct(F.col("_c_statut").alias("statut"), F.col("_c_message").alias("message"),
                                           F.col("_c_grade_actuel").alias("grade_actuel"),
                                           F.when(present, estimate).alias("estimation"))).alias("coherence"),
        F.when(it == "estimer_nutriscore", estimate).alias("estimation"),
    ]


NEIGHBOURS = ("array<struct<code:string,product_name:string,categories_en:string,nutrition_grade_fr:string,"
              "similarite:double>>")


def _analyse(s: DataFrame, has_local: Column, has_ext: Column) -> DataFrame:
    it = F.col("intention")
    # additive: code from the question, else from the context, else E330
    s = s.withColumn("add_code", F.coalesce(F.col("code_additif"), lookup.additive_code(F.col("contexte_rag")),
                                            F.lit(DEFAULT_ADDITIVE)))
    s = lookup.explain_additive(s, "add_code", tables.additives(s.sparkSession))
    ambiguous = F.col("n_cand") > 1
    amb_list = F.concat(F.lit("["), F.array_join(F.transform(F.slice("cand_list", 1, 5), lambda x: F.concat(
        F.lit("{'code': "), _py_str(x["code"]), F.lit(", 'product_name': "), _py_str(x["product_name"]),
        F.lit("}"))), ", "), F.lit("]"))
    no_ref = F.col("ref2") == ""
    nom = F.when(has_local, F.coalesce(F.col("l_product_name"), F.lit(""))).otherwise(F.col("ref2"))

    # product used by coherence / estimate: local, else external, else none
    local_flat = N.products_flat("l_")
    ext_flat = {"product_name": F.col("x_product_name"), "nutriscore_grade": F.col("x_nutrition_grades"),
                "nutriscore_score": F.col("x_nutrition_score_fr_100g")}
    keys = set(local_flat) | set(ext_flat)
    flat = {key: F.when(has_local, local_flat.get(key, F.lit(None)).cast("string"))
            .when(has_ext, ext_flat.get(key, F.lit(None)).cast("string")) for key in keys}
    # numeric columns keep their type (numbers are missing only when null)
    for key in ("sugars_100g", "saturated-fat_100g", "salt_100g", "fiber_100g", "proteins_100g", "fat_100g"):
        flat[key] = F.when(has_local, local_flat[key])
    flat["nutriscore_score"] = F.when(~has_local & has_ext, F.col("x_nutrition_score_fr_100g").cast("double"))
    flat["nutrition-score-fr_100g"] = F.when(has_local, local_flat["nutrition-score-fr_100g"].cast("double"))
    present = has_local | has_ext
    s = N.add_normalized(s, flat, F.when(~has_local & has_ext, F.col("x_nutriments")))
    s = N.add_coherence(N.add_estimate(s), present)
    est_name = F.when(has_local, F.coalesce(F.col("l_product_name"), F.lit(""))) \
        .when(has_ext, F.coalesce(F.col("x_product_name"), F.lit("ce produit"))).otherwise(F.lit("ce produit"))
    # origin from the product reference source
    country = lookup.country_text(F.col("x_countries"), F.col("x_countries_tags"))
    pays = F.when(has_ext & (country != ""), country).otherwise(F.lit("information non trouvee"))

    def branch(col_rep, col_enr, col_jus):
        return col_rep, col_enr, col_jus

    rows = {
        "additif": branch(
            F.concat(F.col("add_code"), F.lit(" correspond a "), F.col("nom"),
                     F.lit(". Son role principal est : "), F.col("role"), F.lit(". "), F.col("description")),
            F.concat(F.lit("Ajouter une fiche additif structuree avec code, nom, role et source fiable. "
                           "Source retenue : "), F.col("source_nom"), F.lit(" ("), F.col("url_source"), F.lit(").")),
            F.concat(F.lit("La reponse s'appuie sur la fiche locale de l'additif et sur une source externe "
                           "referencee : "), F.col("url_source"), F.lit("."))),
        "categorie": branch(
            F.when(no_ref & ambiguous, F.lit("Plusieurs produits correspondent a la demande, je ne peux pas "
                                             "proposer une categorie unique sans precision."))
            .when(no_ref, F.lit("Je n'ai pas trouve de produit cible explicite pour proposer une categorie."))
            .otherwise(F.concat(F.lit("Pour "), nom, F.lit(", la categorie la plus plausible est : "),
                                F.coalesce("categorie_suggeree", F.lit("Categorie indeterminee")), F.lit("."))),
            F.when(no_ref & ambiguous, F.lit("Preciser le code-barres ou le nom exact du produit parmi les "
                                             "candidats proposes."))
            .when(no_ref, F.lit("Fournir un nom produit ou un code-barres."))
            .otherwise(F.concat(F.lit("Renseigner le champ categories_en avec "),
                                F.coalesce("categorie_suggeree", F.lit("Categorie indeterminee")),
                                F.lit(" puis demander une validation humaine."))),
            F.when(no_ref & ambiguous, F.concat(F.lit("Ambiguite detectee en SQL local: "), amb_list))
            .when(no_ref, F.lit("Aucune reference exploitable dans la question."))
            .otherwise(F.concat(F.lit("La proposition vient des produits les plus proches dans la base, dont les "
                                      "categories dominantes sont : "),
                                F.coalesce("categories_repr", F.lit("[]")), F.lit(".")))),
        "origine": branch(
            F.when(F.col("code_eff").isNotNull(),
                   F.concat(F.lit("Le code-barres "), F.col("code_eff"),
                            F.lit(" renvoie le pays d'origine suivant : "), pays, F.lit(".")))
            .otherwise(F.lit("Aucun code-barres explicite n'a ete detecte dans la question.")),
            F.when(F.col("code_eff").isNotNull(),
                   F.lit("Completer le champ countries_en avec la valeur retournee par l'API Open Food Facts si "
                         "elle est validee."))
            .otherwise(F.lit("Fournir un code-barres ou un produit cible pour completer le pays d'origine via "
                             "l'API Open Food Facts.")),
            F.when(F.col("code_eff").isNotNull(),
                   F.lit("Le pays provient de l'API Open Food Facts interrogee a partir du code-barres."))
            .otherwise(F.concat(F.lit("Exemples locaux de produits a completer : "), F.col("exemples")))),
        "similarite": branch(
            F.when(no_ref & ambiguous, F.lit("Je detecte plusieurs produits possibles, donc je ne peux pas "
                                             "calculer une similarite ciblee sans precision."))
            .when(no_ref, F.lit("Je n'ai pas trouve de produit de reference pour la recherche de similarite."))
            .when(F.col("similar_lines").isNotNull(),
                  F.concat(F.lit("Produits similaires mieux notes trouves : "), F.col("similar_lines")))
            .otherwise(F.lit("Aucun produit similaire mieux note n'a ete trouve.")),
            F.when(no_ref & ambiguous, F.lit("Donner le code-barres exact du produit a comparer."))
            .when(no_ref, F.lit("Fournir un nom de produit ou un code-barres."))
            .otherwise(F.lit("Ajouter au produit courant une liste de recommandations alternatives mieux "
                             "notees.")),
            F.when(no_ref & ambiguous, F.concat(F.lit("Ambiguite detectee en SQL local: "), amb_list))
            .when(no_ref, F.lit("Aucune reference exploitable dans la question."))
            .otherwise(F.lit("La similarite est calculee sur le nom, la categorie, les ingredients et la marque "
                             "via TF-IDF."))),
        "coherence": branch(
            F.col("_c_message"),
            F.lit("Conserver le Nutri-Score actuel s'il est coherent, sinon signaler une verification manuelle."),
            F.when(present, F.col("_e_justification"))
            .otherwise(F.lit("Comparaison realisee a partir des nutriments disponibles."))),
        "estimer_nutriscore": branch(
            F.concat(F.lit("Pour "), est_name, F.lit(", le Nutri-Score estime est "),
                     F.upper(F.col("_e_grade_estime")), F.lit(" (score "),
                     N.num_text(F.col("_e_score_estime")), F.lit(").")),
            F.lit("Ajouter le Nutri-Score estime comme proposition d'enrichissement en attendant validation "
                  "humaine."),
            F.col("_e_justification")),
        "rag": branch(
            F.lit("Voici la meilleure synthese disponible a partir du contexte local."),
            F.lit("Enrichir le produit avec les champs manquants identifies dans le contexte."),
            F.coalesce(_nb(F.col("contexte_rag")), F.lit("Aucun contexte local supplementaire disponible."))),
    }
    out = []
    for i, name in enumerate(("a_reponse", "a_enrichissement", "a_justification")):
        expr = None
        for intent, cols in rows.items():
            expr = F.when(it == intent, cols[i]) if expr is None else expr.when(it == intent, cols[i])
        out.append(expr.alias(name))
    return s.select("*", *out, pays.alias("a_pays"))


def api_response(df: DataFrame) -> DataFrame:
    """The answer as the service returns it."""
    return df.select(F.col("reponse").alias("response"), F.col("intention").alias("intent"), "question")


def api_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15 over Q9: every question's answer as the service returns it."""
    return api_response(answers(spark, sf_dir))


def context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 over L4: for every question, its 4 closest product documents
    joined by a blank line."""
    q = tables.questions(spark, sf_dir).select("q_id", "question")
    return retrieval_context(spark, q, misc.product_documents(tables.products(spark, sf_dir)))
