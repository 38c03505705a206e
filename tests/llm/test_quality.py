"""Quality model: features, boosting, held-out accuracy, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from casebase.llm import quality as Q
from casebase.llm.common import bounded_sample, held_out


def test_features_of_odd_texts():
    for text in (None, "", " ", "\n\n", "a", "é😀\x00", "word " * 50_000):
        x = Q.text_features(text)
        assert len(x) == len(Q.FEATURES) and np.isfinite(x).all()
    assert Q.text_features(None) == Q.text_features("")
    f = dict(zip(Q.FEATURES, Q.text_features("AB ab 12 12\nab!"), strict=True))
    assert f["log_words"] == np.log1p(5) and f["upper"] == 2 / 6 and f["types"] == 4 / 5
    assert f["top_word"] == 2 / 5 and f["echo"] == 1 / 4 * 4 / 5 and f["shouts"] == 1 / 5


def test_tables_learn_shapes_and_a_pair():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, 3))
    odds = 18 * (np.abs(x[:, 0]) < 0.4) - 9 + 14 * np.sign(x[:, 1] * x[:, 2])
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-odds))).astype(float)
    with_pairs = Q.train(x[:3000], y[:3000], pairs=1)
    without = Q.train(x[:3000], y[:3000], pairs=0)
    assert list(with_pairs.pairs) == [(1, 2)]
    right = [((m.score(x[3000:]) >= 0.5) == y[3000:]).mean() for m in (with_pairs, without)]
    assert right[0] > 0.9 and right[0] > right[1] + 0.1
    b = with_pairs.bins(x[:5])                            # a score is a sum of table entries
    total = [with_pairs.bias + sum(t[b[i, f]] for f, t in enumerate(with_pairs.tables))
             + sum(t[with_pairs.coarse[f][b[i, f]], with_pairs.coarse[g][b[i, g]]]
                   for (f, g), t in with_pairs.pairs.items()) for i in range(5)]
    assert np.allclose(with_pairs.score(x[:5]), 1 / (1 + np.exp(-np.array(total))))


def _docs(spark, prose):
    rows = [(i, prose("aa", 30 + i % 50, i) if i % 4 else "!! ## " * (5 + i % 30), "x")
            for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, None, None), (900, "", "y"), (0, rows[0][1], "z")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)] + [(3, 0), (None, 1), (7, None)],
                                   "doc_id long, quality int")
    return docs, labels


def test_held_out_rows(spark, prose):
    docs, labels = _docs(spark, prose)
    model = Q.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    got = Q.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    rows = got.withColumn("out", held_out(F.col("doc_id"))).collect()
    assert len(rows) == 203 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    out = [r for r in rows if r.out and r.doc_id is not None and r.doc_id < 200]
    assert len(out) > 20 and all(r.predicted == int(r.doc_id % 4 > 0) for r in out)


def test_without_labels_or_rows(spark, prose):
    docs, labels = _docs(spark, prose)
    none = labels.where(F.lit(False))
    assert {r.predicted for r in Q.score(docs, Q.fit(docs, none)).collect()} == {1}
    assert {r.predicted for r in Q.score(docs, Q.fit(docs, labels.where("quality = 0"))).collect()} == {0}
    empty = docs.where(F.lit(False))
    assert Q.score(empty, Q.fit(empty, labels)).count() == 0


def test_bounded_sample(spark):
    rows = spark.range(10_000).withColumnRenamed("id", "k")
    n = bounded_sample(rows, "k", 500).count()
    assert 350 < n < 650
    assert bounded_sample(rows, "k", 10_000).count() == 10_000
    same = rows.withColumn("k", F.lit(5))
    assert bounded_sample(same, "k", 50).count() <= 100
