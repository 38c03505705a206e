"""Oracle SQL for every registered job (same names, same output columns)."""

from __future__ import annotations

from ..functions.splits import sql_fold, sql_is_train
from .jobs import K, MISSING, RADIUS, REPS, RNO
from .sql_forms import Forms, _uniq, query


def _f(cb: str, reps: int = 0, split: bool = True) -> Forms:
    return Forms(cb, reps=reps, k=K, radius=RADIUS, rno=RNO, split=split)


def _stats(cb: str, select: str, split: bool = True) -> str:
    f = _f(cb, split=split)
    return query(f.base() + f.stats(), select)


def _joint(key: str, **options) -> str:
    f = Forms("docs", **options)
    return query(f.base() + f.stats(), f"SELECT g AS {key}, feature, value, label, n FROM jt")


def _sigma(cb: str) -> str:
    f = _f(cb)
    sel = " UNION ALL ".join(f"SELECT '{n}' AS feature, s_{n} AS sigma FROM sig"
                             for n in f.spec.numeric)
    return query(f.base() + f.stats(), sel)


def _knn_topk(cb: str) -> str:
    f = _f(cb)
    return query(f.base() + f.stats() + f.knn("nb", K),
                 "SELECT query_id, rank, case_id, distance FROM nb")


def _knn_predict(cb: str) -> str:
    f = _f(cb)
    return query(f.base() + f.stats() + f.knn_vote(),
                 "SELECT query_id, label, prediction FROM pred")


def _adapt_ctes(cb: str, reps: int = 0) -> list[str]:
    f = _f(cb, reps)
    return _uniq(f.base() + f.stats() + f.rules() + f.adaptation())


def _adapt_predict(cb: str) -> str:
    return query(_adapt_ctes(cb), "SELECT query_id, label, prediction FROM pred")


def _rule_topk(cb: str) -> str:
    return query(_adapt_ctes(cb),
                 "SELECT query_id, base_id, base_rank, src_id, dst_id, direction, rule_rank, "
                 "rule_distance, to_label FROM rt")


_METRIC_COLS = ("n_test, n_errors, error_rate, weighted_precision, weighted_recall, "
                "weighted_f1, weighted_fpr, weighted_tpr")


def _metrics(cb: str, method: str) -> str:
    f = _f(cb)
    ctes = _adapt_ctes(cb) if method == "adapt" else f.base() + f.stats() + f.knn_vote()
    return query(ctes + f.metrics(), f"SELECT {_METRIC_COLS} FROM mt")


def _holdout(cb: str, method: str) -> str:
    f = _f(cb, REPS)
    if method == "adapt":
        ctes = _uniq(f.base() + f.stats() + f.rules() + f.adaptation())
    else:
        ctes = f.base() + f.stats() + f.knn_vote()
    return query(ctes + f.metrics(),
                 f"SELECT g AS rep, {_METRIC_COLS}, '{method}' AS method FROM mt")


def _rules_docs() -> str:
    f = _f("docs")
    cols = ", ".join(f"{c}_from, {c}_to" for c in f.spec.order)
    return query(f.base() + f.stats() + f.rules(),
                 f"SELECT src_id, dst_id, direction, rank, from_label, to_label, {cols} FROM rl")


def _rules_union_docs() -> str:
    f = _f("docs")
    cols = ", ".join(f"{c}_from, {c}_to" for c in f.spec.order)
    rev = ", ".join(f"{c}_to AS {c}_from, {c}_from AS {c}_to" for c in f.spec.order)
    return query(f.base() + f.stats() + f.rules(),
                 f"SELECT src_id, dst_id, direction, rank, from_label, to_label, {cols} FROM rl "
                 f"UNION ALL SELECT dst_id AS src_id, src_id AS dst_id, 1 AS direction, rank, "
                 f"to_label AS from_label, from_label AS to_label, {rev} FROM rl")


def _rules_select(select: str) -> str:
    f = _f("docs")
    return query(_uniq(f.base() + f.stats() + f.rules()), select)


def _split_pair(col: str, a: str, b: str) -> str:
    return (f"split_part({col}, chr(1), 1) AS {a}, "
            f"substr({col}, strpos({col}, chr(1)) + 1) AS {b}")


def _antecedents_docs() -> str:
    f = _f("docs")
    return query(_uniq(f.base() + f.stats() + f.rules() + f.adaptation()),
                 "SELECT query_id, base_id, base_rank, base_label, "
                 + ", ".join(f.spec.order) + " FROM an")


def _index(col: str, name: str, expr: str | None = None) -> str:
    e = expr or col
    return (f"{name} AS (SELECT g, {e} AS value, CAST(row_number() OVER (PARTITION BY g ORDER BY "
            f"count(*) DESC, {e}) - 1 AS DOUBLE) AS idx FROM tr GROUP BY g, {e})")


def _indexed(select: str) -> str:
    f = _f("docs")
    ctes = f.base() + [_index("lang", "li"), _index("source", "si"),
                       _index("label", "yi", "CAST(label AS VARCHAR)")]
    return query(ctes, select + " FROM tr JOIN li ON li.value = tr.lang "
                 "JOIN si ON si.value = tr.source JOIN yi ON yi.value = CAST(tr.label AS VARCHAR)")


def _prep() -> dict[str, str]:
    f = _f("docs")
    f10 = _f("docs", reps=REPS, split=False)
    train = sql_is_train("cb.id", "gs.g")
    return {
        "string_index_docs": _indexed("SELECT tr.id AS doc_id, li.idx AS lang_idx, "
                                      "si.idx AS source_idx"),
        "assembled_docs": _indexed("SELECT tr.id AS doc_id, yi.idx AS label_idx, li.idx AS x_lang, "
                                   "si.idx AS x_source, tr.n_chars AS x_n_chars"),
        "libsvm_roundtrip_docs": _indexed("SELECT yi.idx AS label_idx, li.idx AS x_lang, "
                                          "si.idx AS x_source, tr.n_chars AS x_n_chars"),
        "drop_missing_docs": query(
            f.base(), "SELECT id AS doc_id, label, lang, source, n_chars FROM cb WHERE "
            f"lang <> '{MISSING}' AND source <> '{MISSING}' AND CAST(n_chars AS VARCHAR) <> '{MISSING}'"),
        "split_counts_docs": query(
            f10.base()[:2], f"SELECT gs.g AS rep, CASE WHEN {train} THEN 'train' ELSE 'test' END "
            f"AS side, count(*) AS n FROM cb CROSS JOIN gs GROUP BY ALL"),
        "kfold_counts_docs": query(
            f.base()[:1], f"SELECT {sql_fold('id', 10)} AS fold, "
            f"count(*) AS n FROM cb GROUP BY ALL"),
        "csv_roundtrip_docs": query(
            f.base()[:1], "SELECT CAST(id AS DOUBLE) AS doc_id, CAST(label AS VARCHAR) AS label, "
            "lang, source, n_chars FROM cb"),
        "model_roundtrip_docs": _adapt_predict("docs"),
        "neighbours_sink_docs": _knn_topk("docs"),
        "results_sink_docs": _holdout("docs", "knn"),
    }


def _nb_ctes(reps: int = 0) -> list[str]:
    """Multinomial naive Bayes (smoothing 1) over indexed features, argmax with first-max ties;
    one model a repetition ``g``."""
    ctes = _f("docs", reps).base() + [_index("lang", "li"), _index("source", "si"),
                                      _index("label", "yi", "CAST(label AS VARCHAR)")]
    x = ("{t}.g, {t}.id AS id, {t}.label AS label, coalesce(li.idx, nl.c) AS x0, "
         "coalesce(si.idx, ns.c) AS x1, {t}.n_chars AS x2")
    j = (" FROM {t} JOIN (SELECT g, count(*) AS c FROM li GROUP BY g) nl ON nl.g = {t}.g "
         "JOIN (SELECT g, count(*) AS c FROM si GROUP BY g) ns ON ns.g = {t}.g "
         "LEFT JOIN li ON li.g = {t}.g AND li.value = {t}.lang "
         "LEFT JOIN si ON si.g = {t}.g AND si.value = {t}.source")
    ctes += [
        "xtr AS (SELECT yi.idx AS y, " + x.format(t="tr") + j.format(t="tr")
        + " JOIN yi ON yi.g = tr.g AND yi.value = CAST(tr.label AS VARCHAR))",
        "xte AS (SELECT " + x.format(t="te") + j.format(t="te") + ")",
        "cc AS (SELECT g, y, count(*) AS n, sum(x0) AS s0, sum(x1) AS s1, sum(x2) AS s2 "
        "FROM xtr GROUP BY g, y)",
        "nl AS (SELECT g, count(*) AS c, sum(n) AS nn FROM cc GROUP BY g)",
        "th AS (SELECT cc.g, y, ln(n + 1.0) - ln(nn + c * 1.0) AS pi, "
        "ln(s0 + 1.0) - ln(s0 + s1 + s2 + 3.0) AS t0, ln(s1 + 1.0) - ln(s0 + s1 + s2 + 3.0) AS t1, "
        "ln(s2 + 1.0) - ln(s0 + s1 + s2 + 3.0) AS t2 FROM cc JOIN nl ON nl.g = cc.g)",
        "sc AS (SELECT xte.g, xte.id, xte.label, th.y, "
        "t0 * x0 + t1 * x1 + t2 * x2 + pi AS score FROM xte JOIN th ON th.g = xte.g)",
        "pred AS (SELECT sc.g, sc.id AS query_id, sc.label, CAST(yi.value AS INTEGER) AS prediction "
        "FROM (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY score DESC, y) AS r FROM sc) sc "
        "JOIN yi ON yi.g = sc.g AND yi.idx = sc.y WHERE r = 1)",
    ]
    return ctes


def _baselines() -> dict[str, str]:
    from .baselines import RF_GRID
    nb = _nb_ctes()
    cases = query(_f("docs").base(), "SELECT id AS query_id, label FROM te")
    points = " CROSS JOIN ".join(
        f"(VALUES {', '.join(f'({v!r})' for v in RF_GRID[name])}) {name}(v)" for name in RF_GRID)
    return {
        "tvs_cases_docs": cases,
        "lr_cases_docs": cases,
        "tvs_grid_docs": "SELECT CAST(numTrees.v AS INTEGER) AS num_trees, CAST(maxDepth.v AS INTEGER) "
                         "AS max_depth, CAST(maxBins.v AS INTEGER) AS max_bins, impurity.v AS impurity "
                         f"FROM {points}",
        "holdout_lr_counts_docs": query(
            _f("docs", REPS).base(),
            "SELECT g AS rep, count(*) AS n_test, 'lr' AS method FROM te GROUP BY g"),
        "nb_predict_docs": query(nb, "SELECT query_id, label, prediction FROM pred"),
        "metrics_nb_docs": query(nb + Forms.metrics(), f"SELECT {_METRIC_COLS} FROM mt"),
        "holdout_nb_docs": query(_nb_ctes(REPS) + Forms.metrics(),
                                 f"SELECT g AS rep, {_METRIC_COLS}, 'nb' AS method FROM mt"),
    }


def _sweep_docs() -> str:
    from .experiment import KS, RADII, RNOS
    f = Forms("docs", k=max(KS), rno=max(RNOS), folds=10)
    ctes = f.base() + f.stats() + f.antecedents()
    parts = []
    for r in RADII:
        ctes += _uniq(f.rules(radius=r, sfx=f"_{r}")) + f.retrieval(sfx=f"_{r}")
        parts.append(f"SELECT {r} AS radius, g, query_id, base_id, base_rank, rule_rank, to_label "
                     f"FROM rt_{r}")
    ks = ", ".join(f"({k})" for k in KS)
    rs = ", ".join(f"({r})" for r in RNOS)
    ctes += [
        f"ch AS ({' UNION ALL '.join(parts)})",
        f"grid AS (SELECT * FROM (VALUES {ks}) kk(k) CROSS JOIN (VALUES {rs}) rr(rno))",
        "gv AS (SELECT ch.*, grid.k, grid.rno FROM ch JOIN grid ON ch.base_rank <= grid.k "
        "AND ch.rule_rank <= grid.rno)",
        "bv AS (SELECT radius, k, rno, g, query_id, base_id, to_label AS target FROM (SELECT "
        "radius, k, rno, g, query_id, base_id, to_label, row_number() OVER (PARTITION BY radius, "
        "k, rno, g, query_id, base_id ORDER BY count(*) DESC, to_label) AS r FROM gv GROUP BY "
        "radius, k, rno, g, query_id, base_id, to_label) WHERE r = 1)",
        "pv AS (SELECT radius, k, rno, g, query_id, target AS prediction FROM (SELECT radius, k, "
        "rno, g, query_id, target, row_number() OVER (PARTITION BY radius, k, rno, g, query_id "
        "ORDER BY count(*) DESC, target) AS r FROM bv GROUP BY radius, k, rno, g, query_id, "
        "target) WHERE r = 1)",
        "er AS (SELECT pv.radius, pv.k, pv.rno, pv.g, avg(CASE WHEN pv.prediction = te.label "
        "THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) AS e FROM pv JOIN te "
        "ON te.g = pv.g AND te.id = pv.query_id GROUP BY pv.radius, pv.k, pv.rno, pv.g)",
    ]
    return query(ctes, "SELECT CAST(radius AS INTEGER) AS radius, CAST(k AS INTEGER) AS k, "
                       "CAST(rno AS INTEGER) AS rno, round(avg(e), 9) AS mean_error FROM er "
                       "GROUP BY radius, k, rno")


def oracle_sql() -> dict[str, str]:
    return _prep() | _baselines() | {
        "sweep_docs": _sweep_docs(),
        "sweep_best_docs": _sweep_docs() + " ORDER BY mean_error, k, rno, radius LIMIT 1"} | {
        "class_counts_docs": _stats("docs", "SELECT label, count(*) AS n FROM tr GROUP BY label"),
        "joint_counts_docs": _stats("docs", "SELECT feature, value, label, n FROM jt"),
        "value_counts_docs": _stats("docs", "SELECT feature, value, n FROM tot"),
        "joint_counts_line": _stats("line", "SELECT feature, value, label, n FROM jt", split=False),
        "joint_counts_folds_docs": _joint("fold", folds=10),
        "joint_counts_reps_docs": _joint("rep", reps=10),
        "sigma_docs": _sigma("docs"),
        "sigma_cust": _sigma("cust"),
        "sigma_evt": _sigma("evt"),
        "vdm_docs": _stats("docs", "SELECT feature, v1, v2, vdm FROM vdm"),
        "vdm_cust": _stats("cust", "SELECT feature, v1, v2, vdm FROM vdm"),
        "vdm_evt": _stats("evt", "SELECT feature, v1, v2, vdm FROM vdm"),
        "vdm_line": _stats("line", "SELECT feature, v1, v2, vdm FROM vdm", split=False),
        "value_profile_docs": _stats(
            "docs", "SELECT jt.feature, jt.value, jt.label, jt.n, tot.n AS total, "
                    "CAST(jt.n AS DOUBLE) / CAST(tot.n AS DOUBLE) AS p FROM jt JOIN tot "
                    "ON tot.g = jt.g AND tot.feature = jt.feature AND tot.value = jt.value"),
        "knn_topk_docs": _knn_topk("docs"),
        "knn_topk_cust": _knn_topk("cust"),
        "knn_topk_evt": _knn_topk("evt"),
        "knn_topk_emb": _knn_topk("emb"),
        "knn_topk_ord": _knn_topk("ord"),
        "loo_neighbors_ord": query(
            _f("ord").base() + _f("ord").stats() + _f("ord").knn("lo", RADIUS, "tr", True),
            "SELECT query_id, rank, case_id, distance FROM lo"),
        "adapt_predict_ord": _adapt_predict("ord"),
        "knn_predict_ord": _knn_predict("ord"),
        "kth_distance_docs": query(
            _f("docs").base() + _f("docs").stats() + _f("docs").knn("nb", K + 1),
            f"SELECT query_id, distance AS kth_distance FROM nb WHERE rank = {K + 1}"),
        "loo_neighbors_docs": query(
            _f("docs").base() + _f("docs").stats() + _f("docs").knn("lo", RADIUS, "tr", True),
            "SELECT query_id, rank, case_id, distance FROM lo"),
        "rules_docs": _rules_docs(),
        "rules_union_docs": _rules_union_docs(),
        "rule_class_counts_docs": _rules_select(
            "SELECT from_label, to_label, count(*) AS n FROM rl GROUP BY from_label, to_label"),
        "rule_pair_counts_docs": _rules_select(
            "SELECT feature, " + _split_pair("value", "from_value", "to_value") + ", n FROM rtot"),
        "rule_joint_counts_docs": _rules_select(
            "SELECT feature, " + _split_pair("value", "from_value", "to_value") + ", "
            + "CAST(" + "split_part(label, chr(1), 1) AS INTEGER) AS from_label, "
            + "CAST(substr(label, strpos(label, chr(1)) + 1) AS INTEGER) AS to_label, n FROM rjt"),
        "rule_vdm_docs": _rules_select(
            "SELECT feature, " + _split_pair("v1", "from1", "to1") + ", "
            + _split_pair("v2", "from2", "to2") + ", vdm FROM rvdm"),
        "antecedents_docs": _antecedents_docs(),
        "rule_topk_docs": _rule_topk("docs"),
        "rule_topk_cust": _rule_topk("cust"),
        "knn_predict_docs": _knn_predict("docs"),
        "knn_predict_cust": _knn_predict("cust"),
        "knn_predict_evt": _knn_predict("evt"),
        "knn_predict_emb": _knn_predict("emb"),
        "adapt_predict_docs": _adapt_predict("docs"),
        "adapt_predict_cust": _adapt_predict("cust"),
        "confusion_knn_docs": query(_f("docs").base() + _f("docs").stats() + _f("docs").knn_vote(),
                                    "SELECT label, prediction, count(*) AS n FROM pred "
                                    "GROUP BY label, prediction"),
        "confusion_adapt_docs": query(_adapt_ctes("docs"),
                                      "SELECT label, prediction, count(*) AS n FROM pred "
                                      "GROUP BY label, prediction"),
        "error_count_knn_docs": query(
            _f("docs").base() + _f("docs").stats() + _f("docs").knn_vote(),
            "SELECT count(*) AS n_test, CAST(coalesce(sum(CASE WHEN prediction IS NULL OR "
            "prediction <> label THEN 1 END), 0) AS BIGINT) AS n_errors FROM pred"),
        "error_rate_adapt_docs": query(
            _adapt_ctes("docs"),
            "SELECT round(CAST(coalesce(sum(CASE WHEN prediction IS NULL OR prediction <> label "
            "THEN 1 END), 0) AS DOUBLE) / count(*), 9) AS error_rate FROM pred"),
        "metrics_knn_docs": _metrics("docs", "knn"),
        "metrics_adapt_docs": _metrics("docs", "adapt"),
        "metrics_knn_cust": _metrics("cust", "knn"),
        "metrics_adapt_cust": _metrics("cust", "adapt"),
        "holdout_knn_docs": _holdout("docs", "knn"),
        "holdout_adapt_docs": _holdout("docs", "adapt"),
    }
