"""Language ID: held-out accuracy, back-off, odd rows."""

import math

from pyspark.sql import functions as F

from casebase.llm import langid as L
from casebase.llm.common import held_out


def _docs(spark, prose):
    rows = [(i, prose("abc"[i % 3] * 2, 5 + i % 40, i), "abc"[i % 3] * 2) for i in range(300)]
    return spark.createDataFrame([*rows, (500, None, "aa"), (501, "12 34 !!", "bb"), (502, "", None),
                                  (None, "der die das", None), (3, "x" * 50, "cc")],
                                 "doc_id long, text string, lang string")


def test_held_out_accuracy_and_odd_rows(spark, prose):
    docs = _docs(spark, prose)
    got = L.predict(docs, L.fit(docs.where(~held_out(F.col("doc_id")))))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    rows = got.withColumn("out", held_out(F.col("doc_id"))).collect()
    assert len(rows) == 305 and all(0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.out and r.doc_id is not None and r.doc_id < 300 and len(r.text) < 500]
    assert len(out) > 40 and all(r.lang == r.lang_pred for r in out if r.doc_id != 3)
    assert [(r.lang_pred, r.score) for r in rows if r.doc_id in (500, 501, 502)] == [("und", 0.0)] * 3
    assert [r.lang_pred for r in rows if r.doc_id is None] == ["bb"]


def test_known_word_first_then_shorter_grams(spark, prose):
    docs = spark.createDataFrame([(1, "abcd abcd zz zz", "x"), (2, "wxyz wxyz abqq abqq", "y")],
                                 "doc_id long, text string, lang string")
    m = L.fit(docs)
    assert m.langs == ["x", "y"] and "abcd" in m.index[0]
    assert (m.word("abcd") == m.table[m.index[0]["abcd"]]).all()
    # unseen: 'wxyzw' has the known 4-gram wxyz; 'xab' only has known 2-grams; '??' nothing
    assert (m.word("wxyzw") == m.table[m.index[4]["wxyz"]]).all()
    assert (m.word("xab") == m.table[m.index[2]["ab"]]).all() and "xab" not in m.index[3]
    assert (m.word("ππ") == 0).all()
    # by hand: abcd is 2 of x's 4 words, 0 of y's 4; three distinct words a language in all: 2 + 2
    want = math.log((2 + 0.5) / (4 + 0.5 * 4)), math.log(0.5 / (4 + 0.5 * 4))
    assert tuple(m.word("abcd")) == want


def test_slices_change_nothing(monkeypatch, spark, prose):
    m = L.fit(_docs(spark, prose))
    texts = [prose("bb", 300, 1), "x" * 999, prose("cc", 100, 2) + "1" * 50]
    whole = L.predict_texts(m, texts)
    monkeypatch.setattr(L, "SLICE", 40)
    monkeypatch.setattr(L, "CACHE", 3)
    cut = L.predict_texts(m, texts)
    assert cut[0] == whole[0] and all(abs(a - b) < 1e-9 for a, b in zip(cut[1], whole[1], strict=True))


def test_nothing_to_learn_or_read(spark, prose):
    docs = _docs(spark, prose)
    m = L.fit(docs.where("lang = 'zz'"))
    assert {(r.lang_pred, r.score) for r in L.predict(docs, m).collect()} == {("und", 0.0)}
    assert L.predict(docs.where(F.lit(False)), L.fit(docs)).count() == 0


def test_rare_languages_keep_their_rows_and_entries(spark):
    """100 languages, the first with 60 times the rows of the others; bounds far below what there is."""
    def word(lang, j):
        return "".join(chr(ord("a") + (lang * 7 + j * 5 + i * (lang % 13 + 1)) % 26) for i in range(6)) + chr(
            0x4e00 + lang)
    rows, i = [], 0
    for lang in range(100):
        for n in range(300 if lang == 0 else 5):
            rows.append((i, " ".join(word(lang, (n + j) % 9) for j in range(8)), f"l{lang:02d}"))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = L.sample_by_language(docs, "doc_id", "lang", 520).groupBy("lang").count().collect()
    assert len(few) == 100 and {r["count"] for r in few if r.lang != "l00"} == {5}
    m = L.fit(docs, fit_rows=520, max_cells=100 * 1500)
    assert len(m.langs) == 100 and sum(map(len, m.index)) == 1500
    names, _ = L.predict_texts(m, [t for _, t, _ in rows])
    assert sum(a == lang for a, (_, _, lang) in zip(names, rows, strict=True)) >= 0.95 * len(rows)
