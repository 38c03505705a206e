"""Case bases over the driver's parquet tables.

Each builder selects only the columns it needs (the scan's ``ReadSchema``
holds exactly those) and returns ``(spec, cases)``.

* ``docs``: ``labels`` joined to ``documents``; label ``quality*2+toxic``;
  categorical ``lang, source``; numeric ``n_chars``.
* ``cust``: ``customer``; label ``c_mktsegment``; categorical ``c_nationkey``;
  numeric ``c_acctbal``.
* ``evt``: ``events``; label ``event_type``; categorical hour of ``ts``;
  numeric ``value``.
* ``emb``: ``embeddings``; label ``label``; 64 numeric dimensions.
* ``ord``: ``orders``; label ``o_orderpriority``; categorical ``o_orderstatus``
  and year and month of ``o_orderdate`` (all categorical: searched on
  distinct profiles).
* ``line``: ``lineitem`` for statistics only (no unique key); label
  ``l_returnflag``; categorical ``l_linestatus, l_linenumber, l_tax, l_discount``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import FeatureSpec, to_cases

EMB_DIMS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DOCS = FeatureSpec("doc_id", "label", ("lang", "source"), ("n_chars",))
CUST = FeatureSpec("c_custkey", "c_mktsegment", ("c_nationkey",), ("c_acctbal",))
EVT = FeatureSpec("event_id", "event_type", ("hour",), ("value",))
EMB = FeatureSpec("vec_id", "label", (), tuple(f"e{i}" for i in range(EMB_DIMS)))
ORD = FeatureSpec("o_orderkey", "o_orderpriority", ("o_orderstatus", "o_year", "o_month"), ())
LINE = FeatureSpec("l_rowkey", "l_returnflag",
                   ("l_linestatus", "l_linenumber", "l_tax", "l_discount"), ())


def docs(spark: SparkSession, sf_dir: str) -> tuple[FeatureSpec, DataFrame]:
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("label"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return DOCS, to_cases(labels.join(documents, "doc_id"), DOCS)


def cust(spark: SparkSession, sf_dir: str) -> tuple[FeatureSpec, DataFrame]:
    return CUST, to_cases(table(spark, sf_dir, "customer"), CUST)


def evt(spark: SparkSession, sf_dir: str) -> tuple[FeatureSpec, DataFrame]:
    ev = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.hour("ts").alias("hour"), "value")
    return EVT, to_cases(ev, EVT)


def emb(spark: SparkSession, sf_dir: str) -> tuple[FeatureSpec, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    wide = F.col("embedding").isNull() | (F.size("embedding") == EMB_DIMS)
    e = e.where(F.assert_true(wide, f"embeddings must have {EMB_DIMS} dimensions").isNull())
    dims = [F.col("embedding").getItem(i).cast("double").alias(f"e{i}") for i in range(EMB_DIMS)]
    return EMB, to_cases(e.select("vec_id", "label", *dims), EMB)


def ord_(spark: SparkSession, sf_dir: str) -> tuple[FeatureSpec, DataFrame]:
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", "o_orderstatus",
        F.year("o_orderdate").alias("o_year"), F.month("o_orderdate").alias("o_month"))
    return ORD, to_cases(o, ORD)


def line(spark: SparkSession, sf_dir: str) -> tuple[FeatureSpec, DataFrame]:
    li = table(spark, sf_dir, "lineitem").select(
        F.lit(0).cast("long").alias("l_rowkey"), "l_returnflag", "l_linestatus",
        "l_linenumber", "l_tax", "l_discount")
    return LINE, to_cases(li, LINE)


CASEBASES = {"docs": docs, "cust": cust, "evt": evt, "emb": emb, "ord": ord_, "line": line}
