"""Delimited data-set readers.

The reference's readers split comma-separated lines without header, quoting
or trimming, and impose a fixed list of column names: all strings, or doubles
for the numeric columns.  Here that is a scan of text lines with the same rules:
quotes are ordinary characters, an empty field stays an empty string, fields after the last
named one are ignored, and a line with too few fields or a malformed number fails the job.
Empty lines are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import FeatureSpec


@dataclass(frozen=True)
class DataSet:
    """S3: file layout of one data set."""

    columns: tuple[str, ...]
    label: str
    numeric: tuple[str, ...] = ()
    path: str | None = None
    classes: int = 0
    sigma: tuple[tuple[str, float], ...] = ()

    def schema(self) -> T.StructType:
        return T.StructType([
            T.StructField(c, T.DoubleType() if c in self.numeric else T.StringType())
            for c in self.columns])

    def spec(self, id_col: str = "case_id") -> FeatureSpec:
        feats = [c for c in self.columns if c != self.label]
        return FeatureSpec(id_col, self.label,
                           tuple(c for c in feats if c not in self.numeric),
                           tuple(c for c in feats if c in self.numeric), tuple(feats),
                           dict(self.sigma))


# fixed values: column layouts, class counts and spreads of the reference's data sets (no
# header in the files)
CATALOGUE = {
    "car": DataSet(("buying", "maint", "doors", "persons", "lug_boot", "safety",
                    "acceptability"), "acceptability", (), "datasets/careval/car.data", 4),
    "balance": DataSet(("class", "left_weight", "left_distance", "right_weight",
                        "right_distance"), "class", (), "datasets/balance/balance-scale.data", 3),
    "breast_cancer": DataSet(("clump_thickness", "u_cell_size", "u_cell_shape",
                              "marginal_adhesion", "single_epithelial", "bare_nuclei",
                              "bland_chromatin", "normal_nucleoli", "mitoses", "class"), "class",
                             (), "datasets/breastcancer/bcCleaned.data", 2),
    "bankruptcy": DataSet(("industrial_risk", "management_risk", "financial_flexibility",
                           "credibility", "competitiveness", "operating_risk", "class"), "class",
                          (), "datasets/bankruptcy/bankruptcy.data", 2),
    "credit": DataSet(("a1", "a2", "a3", "a4", "a5", "a6", "a7", "a8", "a9", "a10", "a11",
                       "a12", "a13", "a14", "a15", "a16"), "a16",
                      ("a2", "a3", "a8", "a11", "a14", "a15"), "datasets/credit/crxCleaned.data", 2,
                      (("a2", 11.83827), ("a3", 5.027077), ("a8", 3.37112), ("a11", 4.968497),
                       ("a14", 168.2968), ("a15", 5253.279))),
    "adult": DataSet(("age", "workclass", "fnlwgt", "education", "education_num", "marital",
                      "occupation", "relationship", "race", "sex", "capital_gain",
                      "capital_loss", "hours_per_week", "country", "income"), "income",
                     ("age", "fnlwgt", "education_num", "capital_gain", "capital_loss",
                      "hours_per_week"), None, 2,
                     (("age", 13.13466), ("fnlwgt", 105653.0), ("education_num", 2.549995),
                      ("capital_gain", 7406.346), ("capital_loss", 404.2984),
                      ("hours_per_week", 11.97998))),
}


def read_delimited(spark: SparkSession, path: str, dataset: DataSet, sep: str = ",",
                   id_col: str | None = "case_id") -> DataFrame:
    """The scan; S11: an optional key ``id_col``.

    The key is the line's digest and its number among equal lines, so it depends on
    the content alone, not on files, splits or their order.  Equal lines are counted
    with a map-side aggregation, never gathered.
    """
    lines = spark.read.text(path).where(F.length("value") > 0)
    if id_col:
        lines = (lines.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
                 .select("value", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))
                 .select("value", F.concat(F.md5(F.col("value").cast("binary")), F.lit("-"),
                                           F.col("i").cast("string")).alias(id_col)))
    parts = lines.withColumn("p", F.split("value", re.escape(sep), -1))
    n = len(dataset.columns)
    enough = F.assert_true(F.size("p") >= n, f"a line has fewer than {n} fields").isNull()
    parts = parts.where(enough)
    cols = [F.col("p")[i].cast("double" if c in dataset.numeric else "string").alias(c)
            for i, c in enumerate(dataset.columns)]
    return parts.select(*cols, *([id_col] if id_col else []))
