"""The queries that SQL can state equal their SQL; the others run over whole tables."""

import os

import duckdb
import numpy as np
import pytest

from casebase.llm import queries as Q
from casebase.llm import urlrules

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_like_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = Q.queries()[name](spark, SF)
    rel = con.execute(Q.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(cols)
    assert _norm(map(tuple, df.collect()), df.columns) == _norm(rel.fetchall(), cols)


def test_mined_rules_like_sql(spark, monkeypatch):
    """With a low support there are rules on the small table, too."""
    from casebase.llm import oracles
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = urlrules.judge(spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/labels.parquet"),
                        Q.URL_POLICY, min_count=3, min_confidence=0.5)
    want = con.execute(oracles.url_rules(confidence=0.5, least=3)).fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(r[3] is None and r[4] == "block" for r in got)


def test_search_over_the_whole_table(spark):
    got = Q.op4_learned_partitions(spark, SF).collect()
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    found = {(r.query_id, r.vec_id) for r in got}
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        near = ids[np.lexsort((ids, d))[:10]]
        hits, total = hits + sum((q, i) in found for i in near), total + len(near)
    assert len(got) == total and hits / total >= 0.9


@pytest.mark.parametrize("name", ["op1_quality_gam", "op2_simhash_near_dedup", "op9_language_id", "op10_byte_bpe"])
def test_one_row_a_document(spark, name):
    ids = sorted(r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{SF}/documents.parquet'").fetchall())
    assert sorted(r.doc_id for r in Q.queries()[name](spark, SF).collect()) == ids
