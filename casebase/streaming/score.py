"""Scoring streamed query cases with a fitted model.

The reference has no streaming operator; this only lets the batch classifiers
run on micro-batches.  Every micro-batch is classified by the same operators
as a batch query and written to ``<sink>/epoch=<id>`` with overwrite, so a
retried epoch replaces its own output (exactly-once with the checkpoint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import adapt_classify, knn_classify


def score_batches(stream: DataFrame, model, sink: str, checkpoint: str, k: int,
                  rno: int | None = None, method: str = "knn", available_now: bool = True):
    if method not in ("knn", "adapt"):
        raise ValueError(f"unknown method {method!r}")

    def batch(df: DataFrame, epoch_id: int) -> None:
        pred = knn_classify(df, model, k) if method == "knn" else adapt_classify(df, model, k, rno)
        (pred.withColumn("epoch", F.lit(int(epoch_id)))
         .write.mode("overwrite").parquet(f"{sink}/epoch={int(epoch_id)}"))

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
