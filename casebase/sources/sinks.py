"""Sinks (O1-O4, S9): every writer is a distributed DataFrame write."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage


def write_results(df: DataFrame, path: str, fmt: str = "csv", run_id: str = "",
                  started: datetime | None = None) -> None:
    """Result rows (one per rep and method, or per parameter point), each with the run's
    id, start (default: now) and end.

    ``csv`` writes tab-separated text with a header line like the reference's
    result file; ``parquet`` keeps types.  The rows (few) are computed first; the end is the time at
    which they are there.
    """
    started = started or datetime.now(timezone.utc)
    rows, df = df.columns, cut_lineage(df)
    df = df.select(F.lit(run_id).alias("run_id"), F.lit(started).alias("started"),
                   F.lit(datetime.now(timezone.utc)).alias("ended"), *rows)
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("sep", "\t").option("header", "true").csv(path)
    else:
        w.parquet(path)


def read_results(spark: SparkSession, path: str, fmt: str = "csv",
                 schema: str | None = None) -> DataFrame:
    if fmt == "csv":
        r = spark.read.option("sep", "\t").option("header", "true")
        return r.schema(schema).csv(path) if schema else r.option("inferSchema", "true").csv(path)
    return spark.read.parquet(path)


def write_neighbours(nb: DataFrame, path: str, buckets: int | None = None) -> None:
    """O2: neighbour lists as parquet, clustered by a hash bucket of the query; as many buckets
    (and write tasks) as shuffle partitions unless given."""
    if buckets is None:
        buckets = int(nb.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (nb.withColumn("qbucket", F.pmod(F.xxhash64("query_id"), F.lit(buckets)))
     .repartition(buckets, "qbucket").write.mode("overwrite").partitionBy("qbucket").parquet(path))


def write_libsvm(df: DataFrame, path: str, label: str = "label_idx",
                 features: str = "features") -> None:
    """``label index:value ...`` lines via the libsvm data source."""
    (df.select(F.col(label).cast("double").alias("label"), F.col(features).alias("features"))
     .write.mode("overwrite").format("libsvm").save(path))


def read_libsvm(spark: SparkSession, path: str, num_features: int) -> DataFrame:
    return (spark.read.format("libsvm").option("numFeatures", str(num_features)).load(path)
            .select("label", vector_to_array("features").alias("features")))
