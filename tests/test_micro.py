"""Operator goldens on the 8-row micro fixture (values from a brute-force script)."""

import pytest

from casebase import CaseModel, FeatureSpec
from casebase.operators.classify import adapt_classify, adaptation_votes, knn_classify
from casebase.operators.neighbors import kth_distance, nearest

SPEC = FeatureSpec("id", "label", ("f1", "f2"), ("f3",))


@pytest.fixture(scope="module")
def model(spark, micro):
    return CaseModel.fit(micro[0], SPEC, radius=2)


def test_sigma(model):
    row = model.sigma.collect()[0]
    assert row["feature"] == "f3" and row["sigma"] == round(1.7474471175321524, 9)


def test_vdm(model):
    got = {(r.feature, r.v1, r.v2): r.vdm for r in model.vdm().collect()}
    assert got == {("f1", "a", "b"): 1.3333333333333333, ("f1", "a", "c"): 1.0,
                   ("f1", "b", "c"): 0.3333333333333333, ("f2", "x", "y"): 0.9333333333333333}


def test_knn(model, micro):
    nb = nearest(micro[1], model, 3).collect()
    got = {(r.query_id, r.rank): (r.case_id, round(r.distance, 6)) for r in nb}
    assert got == {
        (100, 1): (1, 0.338309), (100, 2): (0, 0.948538), (100, 3): (6, 0.956050),
        (101, 1): (5, 0.427369), (101, 2): (3, 0.598051), (101, 3): (7, 0.970899),
        (102, 1): (4, 1.035149), (102, 2): (6, 1.035149), (102, 3): (0, 1.069143)}


def test_kth_distance(model, micro):
    nb = nearest(micro[1], model, 4)
    got = {r.query_id: round(r.kth_distance, 6) for r in kth_distance(nb, 2).collect()}
    assert got == {100: 0.956050, 101: 0.970899, 102: 1.069143}


def test_rules(model):
    got = sorted((r.src_id, r.dst_id, r.from_label, r.to_label) for r in model.rules.collect())
    want = sorted([(0, 6, "P", "P"), (0, 1, "P", "P"), (1, 6, "P", "P"), (1, 0, "P", "P"),
                   (2, 7, "N", "P"), (2, 4, "N", "P"), (3, 5, "N", "N"), (3, 2, "N", "N"),
                   (4, 2, "P", "N"), (4, 7, "P", "P"), (5, 3, "N", "N"), (5, 7, "N", "P"),
                   (6, 0, "P", "P"), (6, 1, "P", "P"), (7, 2, "P", "N"), (7, 4, "P", "P")])
    assert got == want
    assert model.rules.count() == 8 * 2          # N * radius


def test_rule_vdm(model):
    got = {(r.feature, r.from1, r.to1, r.from2, r.to2): r.vdm for r in model.rule_vdm().collect()}
    assert got[("f2", "x", "x", "y", "y")] == 2.0
    assert got[("f1", "a", "a", "b", "b")] == 2.0
    assert all(0.0 <= v <= 2.0 for v in got.values())


def test_chosen_rules(model, micro):
    got = {}
    for r in adaptation_votes(micro[1], model, 2, 3).collect():
        got.setdefault((r.query_id, r.base_id), []).append(
            (r.rule_rank, f"{r.src_id}-{r.dst_id}", r.to_label, round(r.rule_distance, 6)))
    want = {
        (100, 1): ["1-0 P 1.509508", "1-6 P 1.514239", "6-0 P 2.010701"],
        (100, 0): ["6-1 P 0.207171", "0-1 P 0.338309", "0-6 P 1.021234"],
        (101, 5): ["5-3 N 0.598051", "3-5 N 0.866447", "5-7 P 1.523658"],
        (101, 3): ["3-5 N 0.718316", "5-3 N 1.018264", "3-2 N 1.569904"],
        (102, 4): ["6-0 P 1.0", "7-2 N 1.035149", "0-6 P 1.069143"],
        (102, 6): ["0-6 P 1.0", "4-2 N 1.069143", "6-0 P 1.069143"],
    }
    for key, rows in want.items():
        exp = [(i + 1, *x.split(" ")[:2], float(x.split(" ")[2])) for i, x in enumerate(rows)]
        assert sorted(got[key]) == exp, key


def test_predictions(model, micro):
    knn = {r.query_id: r.prediction for r in knn_classify(micro[1], model, 3).collect()}
    adapted = {r.query_id: r.prediction for r in adapt_classify(micro[1], model, 2, 3).collect()}
    assert knn == {100: "P", 101: "N", 102: "P"}
    assert adapted == {100: "P", 101: "N", 102: "P"}


def test_transform_and_roundtrip(spark, micro, tmp_path):
    m = CaseModel.fit(micro[0], SPEC, radius=2)
    m.save(str(tmp_path / "model"))
    loaded = CaseModel.load(spark, str(tmp_path / "model"))
    for model in (m, loaded):
        assert {r.query_id: r.prediction for r in model.transform(micro[1], 3).collect()} == \
            {100: "P", 101: "N", 102: "P"}
        assert {r.query_id: r.prediction for r in model.transform(micro[1], 2, 3).collect()} == \
            {100: "P", 101: "N", 102: "P"}
