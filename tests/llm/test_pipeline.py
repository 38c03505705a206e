"""The pipeline's stages against brute force, and over odd rows."""

import hashlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_decontaminate import ITEM, SAME
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline as C
from casebase.llm import bpe, langid, quality
from casebase.llm.common import held_out

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, prose, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = []
    for i in range(240):
        lang = "abc"[i % 3] * 2
        text = prose(lang, 40 + i % 30, i) if i % 5 else "## !! %% " * (9 + i % 20)
        rows.append((i, text, lang))
    rows += [(300, rows[1][1], "bb"), (301, rows[3][1].title(), "aa"), (302, rows[2][1] + " ", None),
             (303, prose("aa", 60, 900) + " " + ITEM, "aa"), (304, prose("aa", 60, 901) + " " + SAME, "aa"),
             (305, None, None), (306, "", "aa"), (None, prose("aa", 80, 902), "aa"), (7, rows[7][1], "bb"),
             (8, prose("cc", 45, 903), "cc"), (307, prose("bb", 20_000, 904), "bb")]
    docs = [(k, t, lang, f"s{i % 4}", len(t or "")) for i, (k, t, lang) in enumerate(rows)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def _key(r):
    return repr((r.doc_id, r.text, r.lang, r.source, r.n_chars))


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.collect()]
    for i, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs.collect())
    whole, good, spoken, single, clean, tokens = seen

    table = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~held_out(F.col("doc_id")))
    model = quality.fit(table, labels)
    p = model.score(np.array([quality.text_features(r.text) for r in whole]))
    assert sorted(map(_key, good)) == sorted(_key(r) for r, x in zip(whole, p, strict=True) if x >= 0.7)
    assert {r.doc_id for r in whole if r.text and "##" in r.text}.isdisjoint(r.doc_id for r in good)

    names, scores = langid.predict_texts(langid.fit(table.where(~held_out(F.col("doc_id")))),
                                         [r.text for r in good])
    assert sorted(map(_key, spoken)) == sorted(
        _key(r) for r, n, s in zip(good, names, scores, strict=True) if n != "und" and s >= 0.5)

    prints = {plain_fingerprint(r.text) for r in spoken}
    group = {v: i for i, g in enumerate(plain_components(prints, 3)) for v in g}
    first = {}
    for r in spoken:
        order = (r.doc_id is None, r.doc_id or 0)
        g = group[plain_fingerprint(r.text)]
        first[g] = min(first.get(g, order), order)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in single) == sorted(first.values())
    assert set(map(_key, single)) <= set(map(_key, spoken))
    assert {300, 301, 302}.isdisjoint(r.doc_id for r in single)

    assert sorted(map(_key, clean)) == sorted(_key(r) for r in single if r.doc_id not in (303, 304))
    assert {303, 304} <= {r.doc_id for r in single}

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = []
    for r in clean:
        ids = np.array(library.encode_ordinary(r.text), "<u4").tobytes()
        want.append((r.doc_id, len(ids) // 4, ids, hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(((t.doc_id, t.n_tokens, bytes(t.ids), t.decoded_sha256) for t in tokens), key=repr) == \
        sorted(want, key=repr)


def test_run_and_no_rows(spark, sf):
    assert C.run(spark, sf).count() > 100
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


def test_columns_named_like_results_stay(spark, sf):
    """The first two stages return the documents' own columns, whatever their names."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 20").withColumns({
        "score": F.lit(77.0), "predicted": F.lit("p"), "lang_pred": F.lit("xx"), "_text": F.lit(5), "x": F.lit(1)})
    for _, stage in C.STAGES[:2]:
        out = stage(spark, docs, sf)
        assert out.schema.simpleString() == docs.schema.simpleString()
        rows = out.collect()
        assert rows and {(r.score, r.predicted, r.lang_pred, r["_text"], r.x) for r in rows} == {(77.0, "p", "xx", 5, 1)}
