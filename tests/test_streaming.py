"""Streamed query cases are classified exactly like the batch query."""

import os
import tempfile

from casebase import CaseModel
from casebase.operators.classify import knn_classify
from casebase.plans import jobs
from casebase.streaming.score import score_batches

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    spec, train, test = jobs.sides(spark, SF, "docs")
    m = CaseModel.fit(train, spec)
    root = tempfile.mkdtemp(prefix="casebase-stream-")
    src = os.path.join(root, "in")
    test.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(test.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = score_batches(stream, m, os.path.join(root, "out"), os.path.join(root, "ckpt"), k=5)
    q.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.read.parquet(os.path.join(root, "out"))
                 .select("query_id", "label", "prediction").collect())
    want = sorted(tuple(r) for r in knn_classify(test, m, 5).collect())
    assert got == want
