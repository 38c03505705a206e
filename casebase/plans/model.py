"""The fitted case-base model (C5, C6, C7): a set of DataFrames.

``fit`` learns the value difference metric, the numeric spreads and,
optionally, the adaptation rules with their own metric.  Saving writes each
table as parquet; loading reads them back.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators import rules as R
from ..operators.metric import Metric
from ..operators.neighbors import nearest_within
from ..operators.stats import joint_counts, sigma, value_counts
from ..operators.vdm import vdm
from ..session import cut_lineage
from ..spec import FeatureSpec


@dataclass
class CaseModel:
    spec: FeatureSpec
    by: tuple
    cases: DataFrame
    joint: DataFrame
    values: DataFrame
    sigma: DataFrame
    metric: Metric
    radius: int | None = None
    rules: DataFrame | None = None
    rule_cases: DataFrame | None = None
    rule_joint: DataFrame | None = None
    rule_metric: Metric | None = None
    n_cases: int | None = None
    n_rules: int | None = None
    # search distinct feature profiles; None = automatic (all features categorical)
    compress: bool | None = None

    @property
    def use_profiles(self) -> bool:
        return (not self.spec.numeric) if self.compress is None else bool(self.compress)

    # ---------------------------------------------------------------- fit
    @classmethod
    def fit(cls, cases: DataFrame, spec: FeatureSpec, radius: int | None = None,
            by: Sequence[str] = (), bidirectional: bool = False,
            persist: bool = True, compress: bool | None = None,
            joint: DataFrame | None = None) -> CaseModel:
        """``joint`` gives the counts of ``cases`` (A3) if they are known from elsewhere."""
        by = tuple(by)
        if persist:
            cases = cases.persist(StorageLevel.MEMORY_AND_DISK)
        if spec.categorical:
            # small (distinct values x classes) and read by the value table, the
            # VDM and the profile views: computed once
            joint = joint_counts(cases, spec, by) if joint is None else joint
            if persist:
                joint = joint.persist(StorageLevel.MEMORY_AND_DISK)
        else:
            joint = cases.sparkSession.createDataFrame(
                [], ", ".join([f"`{b}` string" for b in by] +
                              ["feature string", "value string", "label string", "n bigint"]))
        values = value_counts(joint, by)
        sig = cut_lineage(sigma(cases, spec, by))        # a row a numeric feature and key
        model = cls(spec, by, cases, joint, values, sig, Metric.of(spec, joint, sig, by),
                    n_cases=cases.count(),
                    compress=compress)
        if radius:
            model = model.with_rules(radius, bidirectional)
        return model

    def with_rules(self, radius: int, bidirectional: bool = False,
                   neighbours: DataFrame | None = None) -> CaseModel:
        """Rules of the ``radius`` nearest; ``neighbours`` is a leave-self-out search (with
        payload) of at least that depth, if there is one already."""
        nb = nearest_within(self, radius, payload=True) if neighbours is None \
            else neighbours.where(f"rank <= {radius}")
        rule_df = cut_lineage(R.rules(nb, self.cases, self.spec, self.by, bidirectional))
        return self._attach_rules(radius, rule_df)

    def _attach_rules(self, radius: int, rule_df: DataFrame) -> CaseModel:
        by, spec = self.by, self.spec
        rc = R.rule_cases(rule_df, spec, by)
        if spec.categorical:
            rj = R.rule_joint_counts(rc, spec, by)
        else:
            rj = self.joint.limit(0)
        rm = Metric.of(R.rule_spec(spec), rj, self.sigma, by)
        return CaseModel(spec, by, self.cases, self.joint, self.values,
                         self.sigma, self.metric, radius, rule_df, rc, rj, rm,
                         n_cases=self.n_cases, n_rules=rule_df.count(), compress=self.compress)

    def release(self) -> None:
        """Drop what ``fit`` keeps in memory."""
        self.cases.unpersist()
        self.joint.unpersist()

    # -------------------------------------------------------------- scoring
    def transform(self, queries: DataFrame, k: int, rno: int | None = None) -> DataFrame:
        """Score query cases; ``(by.., query_id, label, prediction)``.

        With ``rno`` (and a model fitted with rules) the ensemble of adaptations
        decides, otherwise the vote of the ``k`` nearest cases.
        """
        from ..operators.classify import adapt_classify, knn_classify
        if rno is None:
            return knn_classify(queries, self, k)
        return adapt_classify(queries, self, k, rno)

    # ---------------------------------------------------------- metric views
    def vdm(self) -> DataFrame:
        return vdm(self.joint, self.by, dense=True)

    def rule_vdm(self) -> DataFrame:
        return R.rule_vdm(self.rule_joint, self.by, dense=True)

    # ------------------------------------------------------------- save/load
    def save(self, path: str) -> None:
        """Every table as parquet plus a small JSON descriptor."""
        meta = {"id": self.spec.id, "label": self.spec.label,
                "categorical": list(self.spec.categorical), "numeric": list(self.spec.numeric),
                "order": list(self.spec.order), "sigma": self.spec.sigma, "by": list(self.by),
                "radius": self.radius}
        spark = self.cases.sparkSession
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/meta")
        self.cases.write.mode("overwrite").parquet(f"{path}/cases")
        self.sigma.write.mode("overwrite").parquet(f"{path}/sigma")
        self.joint.write.mode("overwrite").parquet(f"{path}/joint")
        if self.rules is not None:
            self.rules.write.mode("overwrite").parquet(f"{path}/rules")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CaseModel:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        spec = FeatureSpec(meta["id"], meta["label"], tuple(meta["categorical"]),
                           tuple(meta["numeric"]), tuple(meta["order"]), meta["sigma"] or {})
        by = tuple(meta["by"])
        cases = spark.read.parquet(f"{path}/cases")
        joint = spark.read.parquet(f"{path}/joint")
        sig = spark.read.parquet(f"{path}/sigma")
        values = value_counts(joint, by)
        model = cls(spec, by, cases, joint, values, sig, Metric.of(spec, joint, sig, by),
                    n_cases=cases.count())
        if meta["radius"]:
            model = model._attach_rules(meta["radius"], spark.read.parquet(f"{path}/rules"))
        return model
