
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nutrilake.plans import answers, cleaning, grading, impute, lookups, misc, model_eval, similar, vectors
from nutrilake.streaming import questions as question_stream
from nutrilake.streaming import scans

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {
    "clean_products": cleaning.clean_products,
    "distributor_avg_score": cleaning.distributor_avg_score,
    "column_profile": cleaning.column_profile,
    "column_domains": cleaning.column_domains,
    "domain_values": cleaning.domain_values,
    "nutriment_score": grading.nutriment_score,
    "heuristic_grade": grading.heuristic_grade,
    "grade_coherence": grading.grade_coherence,
    "rule_ok_diff": grading.rule_ok_diff,
    "ok_diff_counts": grading.ok_diff_counts,
    "confusion_matrix": grading.confusion_matrix,
    "class_scores": grading.class_scores,
    "overall_scores": grading.overall_scores,
    "question_intents": lookups.question_intents,
    "barcode_lookup": lookups.barcode_lookup,
    "name_search": lookups.name_search,
    "name_regex_search": lookups.name_regex_search,
    "keyword_search": lookups.keyword_search,
    "sql_search": lookups.sql_search,
    "resolve_reference": lookups.resolve_reference,
    "resolve_question": lookups.resolve_question,
    "additive_lookup": lookups.additive_lookup,
    "additive_mining": lookups.additive_mining,
    "missing_country": lookups.missing_country,
    "country_completion": lookups.country_completion,
    "memory_window": misc.memory_window,
    "recent_context": misc.recent_context,
    "exact_sample": misc.exact_sample,
    "split_80_20": misc.split_80_20,
    "product_text": misc.product_text,
    "valid_reference": misc.valid_reference,
    "tsv_scan": misc.tsv_scan,
    "similar_products": similar.similar_products,
    "better_rated": similar.better_rated,
    "similar_all_pairs": similar.similar_all_pairs,
    "category_vote": similar.category_vote,
    "text_pair_similarity": similar.text_pair_similarity,
    "knn_exact": vectors.knn_exact,
    "knn_ivf": vectors.knn_ivf,
    "knn_saved_index": vectors.knn_saved_index,
    "retrieve_topk": vectors.retrieve_topk,
    "document_retrieval": vectors.document_retrieval,
    "embed_model": vectors.embed_model,
    "impute_labels": vectors.impute_labels,
    "completion_report": vectors.completion_report,
    "forest_holdout": model_eval.forest_holdout,
    "forest_full": model_eval.forest_full,
    "forest_confusion": model_eval.forest_confusion,
    "forest_class_scores": model_eval.forest_class_scores,
    "forest_overall": model_eval.forest_overall,
    "forest_ok_diff": model_eval.forest_ok_diff,
    "forest_importances": model_eval.forest_importances,
    "out_of_fold": model_eval.out_of_fold,
    "gain_forest_holdout": model_eval.gain_forest_holdout,
    "out_of_bag": model_eval.out_of_bag,
    "split_statistics": model_eval.split_statistics,
    "answers": answers.answers,
    "context_join": answers.context_join,
    "impute_categories": impute.impute_categories,
    "impute_chain": impute.impute_chain,
    "impute_categories_report": impute.impute_categories_report,
    "sql_guard": misc.sql_guard,
    "cached_table": misc.cached_table,
    "csv_round_trip": misc.csv_round_trip,
    "csv_head": misc.csv_head,
    "api_responses": answers.api_responses,
    "scan_stream": scans.scan_stream,
    "question_stream": question_stream.question_stream,
}
