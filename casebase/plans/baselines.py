"""Baseline learners and tuning (B1-B6, B8, O4) on the library's own learners.

Features: categorical values indexed by descending training frequency
(alphabetical ties, unseen values kept as an extra index) and numeric values,
assembled in spec order; the label is indexed the same way and mapped back.
Tuning always uses the training split only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.forest import forest, predictions, weighted_f1
from ..session import checkpoint_dir, ship_package
from ..spec import FeatureSpec

# fixed values: tuning grids and seeds of the reference's experiments
RF_GRID = {"numTrees": (2, 5, 10, 20, 100), "maxDepth": (2, 4, 6, 8), "maxBins": (120,),
           "impurity": ("entropy", "gini")}
RF_GRID_SMALL = {"numTrees": (1, 5, 10), "maxDepth": (2, 4, 6), "maxBins": (30, 60),
                 "impurity": ("gini",)}
SEED = 10
FOLDS = 10


def _prepare(train: DataFrame, test: DataFrame, spec: FeatureSpec):
    cat = list(spec.categorical)

    def as_str(df):
        return df.select(spec.id, *[F.col(c).cast("string").alias(c + "_s")
                                    for c in [*cat, spec.label]],
                         *[F.col(c) for c in spec.numeric], F.col(spec.label))
    train = as_str(train.where(F.col(spec.label).isNotNull()))
    idx = [StringIndexer(inputCols=[c + "_s" for c in cat], outputCols=[c + "_idx" for c in cat],
                         stringOrderType="frequencyDesc", handleInvalid="keep")] if cat else []
    asm = VectorAssembler(inputCols=[f + "_idx" if spec.kind(f) == "cat" else f
                                     for f in spec.order], outputCol="features")
    model = Pipeline(stages=[*idx, asm]).fit(train)
    # the label on its own: exactly the classes of training, no index for unknown ones;
    # test labels are only carried along
    label = StringIndexer(inputCol=spec.label + "_s", outputCol="label_idx",
                          stringOrderType="frequencyDesc", handleInvalid="error").fit(train)
    return label.transform(model.transform(train)), model.transform(as_str(test)), label.labels


def _predictions(fitted, test_vec: DataFrame, labels, spec: FeatureSpec) -> DataFrame:
    out = IndexToString(inputCol="prediction", outputCol="pred_s", labels=list(labels))
    typ = test_vec.schema[spec.label].dataType
    return (out.transform(fitted.transform(test_vec))
            .select(F.col(spec.id).alias("query_id"), F.col(spec.label).alias("label"),
                    F.col("pred_s").cast(typ).alias("prediction")))


def _rf_grid(rf: RandomForestClassifier, grid: dict):
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(getattr(rf, name), list(values))
    return b.build()


def _report(spark, grid_maps, metrics: Sequence[float]) -> DataFrame:
    """One row per grid point with its average validation metric."""
    out = []
    for pm, metric in zip(grid_maps, metrics):
        named = {p.name: v for p, v in pm.items()}
        out.append((int(named.get("numTrees", 0)), int(named.get("maxDepth", 0)),
                    int(named.get("maxBins", 0)), str(named.get("impurity", "")), float(metric)))
    return spark.createDataFrame(
        out, "num_trees int, max_depth int, max_bins int, impurity string, avg_metric double")


def _depths(rf: RandomForestClassifier, maps: Sequence[dict], features: int, classes: int) -> list:
    """``(map to fit, {depth: grid point})``: grid points that differ in depth alone share the deepest forest, if all
    nodes of its last level fit the library's memory at once (else the draws of its levels mix)."""
    groups: dict = {}
    for i, pm in enumerate(maps):
        rest = tuple(sorted((p.name, v) for p, v in pm.items() if p != rf.maxDepth))
        groups.setdefault(rest, []).append((pm.get(rf.maxDepth, rf.getMaxDepth()), i))
    out = []
    for points in groups.values():
        deepest, at = max(points)
        trees, bins = maps[at].get(rf.numTrees, rf.getNumTrees()), maps[at].get(rf.maxBins, rf.getMaxBins())
        node = features * bins * (classes + 1) * 8
        if node * trees * 2 ** max(0, deepest - 1) <= rf.getMaxMemoryInMB() << 20:
            out.append((maps[at], dict(points)))
        else:
            out += [(maps[i], {depth: i}) for depth, i in points]
    return out


def _fold_metrics(rf: RandomForestClassifier, maps: Sequence[dict], train: DataFrame, validation: DataFrame,
                  features: int, classes: int, parallelism: int) -> list[float]:
    """The f1 of every grid point, fitted on ``train``, over all rows of ``validation``."""
    spark = train.sparkSession
    ship_package(spark)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    runs = _depths(rf, maps, features, classes)

    def fit(run):
        pm, points = run
        path = f"{checkpoint_dir(spark).rstrip('/')}/casebase-out/forest-{uuid.uuid4().hex}"
        rf.fit(train, pm).write().save(path)
        return forest(spark.read.parquet(f"{path}/data").collect(), list(points))    # bounded by trees and depth

    tasks = [inheritable_thread_target(spark)(lambda run=run: fit(run)) for run in runs]
    with ThreadPool(min(parallelism, len(runs))) as pool:
        tables = spark.sparkContext.broadcast(pool.map(lambda f: f(), tasks, chunksize=1))
    train.unpersist()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict = {}
        for pdf in batches:
            if not len(pdf):
                continue
            # equal vectors are judged once
            x, row = np.unique(np.stack(pdf["x"].to_numpy()), axis=0, return_inverse=True)
            label = pdf["label_idx"].to_numpy().astype(np.int64)
            for i, trees in enumerate(tables.value):
                for depth, pred in predictions(trees, x).items():
                    both, n = np.unique(np.stack([label, pred[row.ravel()]]), axis=1, return_counts=True)
                    for c, p, m in zip(*both.tolist(), n.tolist(), strict=True):
                        counts[i, depth, c, p] = counts.get((i, depth, c, p), 0) + m
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["run", "depth", "label", "prediction", "n"])

    judged = (validation.select("label_idx", vector_to_array("features").alias("x"))
              .mapInPandas(judge, "run int, depth int, label int, prediction int, n long")
              .groupBy("run", "depth", "label", "prediction").agg(F.sum("n").alias("n")).collect())
    confusion: dict = {}
    for r in judged:
        confusion.setdefault(runs[r["run"]][1][r["depth"]], {})[r["label"], r["prediction"]] = r["n"]
    tables.unpersist()
    return [weighted_f1(confusion.get(i, {})) for i in range(len(maps))]


def _tuned(tr: DataFrame, te: DataFrame, labels, spec: FeatureSpec, grid: dict, seed: int, parallelism: int, folds):
    """The best grid point's predictions, and the report; ``folds`` gives the conditions for validation rows
    from a random column."""
    # every fold and grid point re-reads the training vectors: materialise once
    tr = tr.select("label_idx", "features").persist(StorageLevel.MEMORY_AND_DISK)
    rf = RandomForestClassifier(labelCol="label_idx", featuresCol="features", seed=seed,
                                featureSubsetStrategy="auto")
    maps = _rf_grid(rf, grid)
    drawn = tr.select("*", F.rand(seed).alias("_rand"))
    metrics = np.mean([_fold_metrics(rf, maps, drawn.where(~held), drawn.where(held), len(spec.order), len(labels),
                                     parallelism) for held in folds(F.col("_rand"))], axis=0)
    best = rf.fit(tr, maps[int(np.argmax(metrics))])
    tr.unpersist()
    return _predictions(best, te, labels, spec), _report(tr.sparkSession, maps, metrics)


def random_forest_cv(train: DataFrame, test: DataFrame, spec: FeatureSpec, grid: dict = RF_GRID,
                     folds: int = FOLDS, seed: int = SEED, parallelism: int = 8):
    """B1 + B2/B3 + B4: k-fold cross-validated random forest (metric f1), the library's folds.

    Returns ``(predictions, report)``; forests are fitted ``parallelism`` at a time, one for all depths of the grid.
    """
    tr, te, labels = _prepare(train, test, spec)
    h = 1.0 / folds
    return _tuned(tr, te, labels, spec, grid, seed, parallelism,
                  lambda r: [(r >= i * h) & (r < (i + 1) * h) for i in range(folds)])


def random_forest_tvs(train: DataFrame, test: DataFrame, spec: FeatureSpec, grid: dict = RF_GRID,
                      train_ratio: float = 0.75, seed: int = SEED, parallelism: int = 8):
    """train/validation-split tuned random forest."""
    tr, te, labels = _prepare(train, test, spec)
    return _tuned(tr, te, labels, spec, grid, seed, parallelism, lambda r: [r >= train_ratio])


def naive_bayes(train: DataFrame, test: DataFrame, spec: FeatureSpec,
                smoothing: float = 1.0) -> DataFrame:
    """Multinomial naive Bayes on index-valued categorical and raw numeric features."""
    tr, te, labels = _prepare(train, test, spec)
    nb = NaiveBayes(labelCol="label_idx", featuresCol="features", smoothing=smoothing,
                    modelType="multinomial")
    return _predictions(nb.fit(tr), te, labels, spec)


def logistic(train: DataFrame, test: DataFrame, spec: FeatureSpec) -> DataFrame:
    """multinomial/binomial logistic regression (L-BFGS), no intercept, no penalty."""
    tr, te, labels = _prepare(train, test, spec)
    lr = LogisticRegression(labelCol="label_idx", featuresCol="features", regParam=0.0,
                            fitIntercept=False, family="auto")
    return _predictions(lr.fit(tr), te, labels, spec)
