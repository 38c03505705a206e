"""Registry of the named jobs (the ``queries()`` of the driver contract)."""

from __future__ import annotations

from . import jobs

NAMES = [
    "class_counts_docs", "joint_counts_docs", "value_counts_docs", "joint_counts_line",
    "joint_counts_folds_docs", "joint_counts_reps_docs",
    "sigma_docs", "sigma_cust", "sigma_evt",
    "vdm_docs", "vdm_cust", "vdm_evt", "vdm_line", "value_profile_docs",
    "knn_topk_docs", "knn_topk_cust", "knn_topk_evt", "knn_topk_emb", "knn_topk_ord",
    "loo_neighbors_ord", "knn_predict_ord", "adapt_predict_ord",
    "kth_distance_docs", "loo_neighbors_docs",
    "rules_docs", "rules_union_docs", "rule_class_counts_docs", "rule_pair_counts_docs",
    "rule_joint_counts_docs", "rule_vdm_docs", "antecedents_docs",
    "rule_topk_docs", "rule_topk_cust",
    "knn_predict_docs", "knn_predict_cust", "knn_predict_evt", "knn_predict_emb",
    "adapt_predict_docs", "adapt_predict_cust",
    "confusion_knn_docs", "confusion_adapt_docs", "error_count_knn_docs",
    "error_rate_adapt_docs", "metrics_knn_docs", "metrics_adapt_docs", "metrics_knn_cust",
    "metrics_adapt_cust", "holdout_knn_docs", "holdout_adapt_docs", "holdout_nb_docs",
    "holdout_lr_docs", "holdout_rf_docs",
    "string_index_docs", "assembled_docs", "drop_missing_docs", "split_counts_docs",
    "kfold_counts_docs", "csv_roundtrip_docs", "libsvm_roundtrip_docs", "model_roundtrip_docs",
    "neighbours_sink_docs", "results_sink_docs",
    "sweep_docs", "sweep_best_docs", "nb_predict_docs", "metrics_nb_docs", "lr_predict_docs", "tvs_predict_docs",
    "tvs_cases_docs", "tvs_grid_docs", "lr_cases_docs", "holdout_lr_counts_docs",
    "rf_tune_small_docs", "rf_cv_docs", "rf_cv_report_docs", "metrics_rf_docs",
]


def queries() -> dict:
    return {name: getattr(jobs, name) for name in NAMES}
