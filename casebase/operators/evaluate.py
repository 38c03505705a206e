"""Evaluation of predictions.

Input: ``(by.., label, prediction)``.  Weighted metrics follow the
multiclass-metrics definitions: every true class ``c`` with ``n_c`` rows
weighs ``n_c / N``;

* precision_c = tp / (tp + fp), 0 when nothing was predicted as c;
* recall_c = tp / n_c (weighted recall = weighted TPR = accuracy);
* f1_c = 2 p r / (p + r), 0 when p + r = 0;
* fpr_c = fp / (N - n_c).

A row is right if its prediction equals its label; a NULL on either side is an error, in counts and metrics alike.

Metrics are rounded to 9 places: per-class terms are summed in shuffle order.
Everything is one aggregation over the confusion counts, which have at most
``classes^2`` rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = 9


def confusion(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by.., label, prediction, n)``."""
    return pred.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def error_count(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by.., n_test, n_errors)``."""
    wrong = F.when(~F.coalesce(F.col("prediction") == F.col("label"), F.lit(False)), 1)
    return pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n_test"),
                                 F.coalesce(F.sum(wrong), F.lit(0)).cast("long").alias("n_errors"))


def error_rate(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by.., error_rate)``."""
    return error_count(pred, by).select(
        *by, F.round(F.col("n_errors") / F.col("n_test"), PLACES).alias("error_rate"))


def metrics(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by.., n_test, n_errors, error_rate, weighted_precision,
    weighted_recall, weighted_f1, weighted_fpr, weighted_tpr)``."""
    out_by = list(by)
    by = [*out_by, "_g"]                      # constant key: no cross join for the total
    conf = confusion(pred.withColumn("_g", F.lit(0)), by)
    truth = conf.groupBy(*by, F.col("label").alias("c")).agg(F.sum("n").alias("n_c"))
    predicted = conf.groupBy(*by, F.col("prediction").alias("c")).agg(F.sum("n").alias("pred_c"))
    tp = conf.where(F.col("label") == F.col("prediction")).select(
        *by, F.col("label").alias("c"), F.col("n").alias("tp"))
    total = conf.groupBy(*by).agg(F.sum("n").alias("N"))
    per = (truth.join(predicted, [*by, "c"], "left").join(tp, [*by, "c"], "left")
           .join(total, by))
    tpc = F.coalesce(F.col("tp"), F.lit(0)).cast("double")
    predc = F.coalesce(F.col("pred_c"), F.lit(0)).cast("double")
    p = F.when(predc == 0, F.lit(0.0)).otherwise(tpc / predc)
    r = tpc / F.col("n_c")
    f1 = F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))
    fp = predc - tpc
    fpr = F.when(F.col("N") == F.col("n_c"), F.lit(None).cast("double")).otherwise(
        fp / (F.col("N") - F.col("n_c")))
    w = F.col("n_c") / F.col("N")
    per = per.select(*by, "N", "n_c", tpc.alias("tpc"), (p * w).alias("wp"), (r * w).alias("wr"),
                     (f1 * w).alias("wf"), (fpr * w).alias("wfpr"))
    agg = per.groupBy(*by).agg(
        F.max("N").alias("n_test"), F.sum("tpc").alias("_tp"),
        F.round(F.sum("wp"), PLACES).alias("weighted_precision"),
        F.round(F.sum("wr"), PLACES).alias("weighted_recall"),
        F.round(F.sum("wf"), PLACES).alias("weighted_f1"),
        F.round(F.sum("wfpr"), PLACES).alias("weighted_fpr"),
        F.round(F.sum("wr"), PLACES).alias("weighted_tpr"))
    return agg.select(
        *out_by, "n_test", (F.col("n_test") - F.col("_tp")).cast("long").alias("n_errors"),
        F.round((F.col("n_test") - F.col("_tp")) / F.col("n_test"), PLACES).alias("error_rate"),
        "weighted_precision", "weighted_recall", "weighted_f1", "weighted_fpr", "weighted_tpr")
