"""VDM on a full factorial of car-like values, against exact fractions."""

from collections import Counter
from fractions import Fraction
from itertools import combinations, product

from casebase.operators.stats import joint_counts
from casebase.operators.vdm import vdm
from casebase.sources.delimited import CATALOGUE, read_delimited


def test_vdm_of_a_file(spark, tmp_path):
    ds = CATALOGUE["car"]
    values = [("low", "med", "high", "vhigh"), ("low", "high"), ("2", "3", "5more"), ("2", "4", "more"),
              ("small", "big"), ("low", "med", "high")]
    rows = []
    for i, row in enumerate(product(*values)):
        good = (row[5] != "low") + (row[3] != "2") + (row[0] in ("low", "med")) + (i % 11 == 0)
        rows.append((*row, ("unacc", "unacc", "acc", "good", "vgood")[good]))
    path = tmp_path / "car.data"
    path.write_text("\n".join(",".join(r) for r in rows) + "\n")
    df = read_delimited(spark, str(path), ds)
    joint = joint_counts(df, ds.spec())
    got = {(r.feature, r.v1, r.v2): r.vdm for r in vdm(joint).collect()}
    want = {}
    for i, f in enumerate(ds.columns[:-1]):
        n, total = Counter((r[i], r[-1]) for r in rows), Counter(r[i] for r in rows)
        for a, b in combinations(sorted(total), 2):
            want[f, a, b] = float(Fraction(sum(abs(n[a, c] * total[b] - n[b, c] * total[a]) for c in {
                r[-1] for r in rows}), total[a] * total[b]))
    assert got == want                     # the correctly rounded value of the integer ratio
    sparse = {(r.feature, r.v1, r.v2): r.vdm for r in vdm(joint, dense=False).collect()}
    assert sparse == {k: v for k, v in want.items() if v < 2.0}


def test_values_without_a_common_class(spark):
    df = spark.createDataFrame([("f", "a", "x", 3), ("f", "b", "y", 2), ("f", "c", "x", 1), ("f", None, "x", 9),
                                ("f", "d", None, 4)], "feature string, value string, label string, n long")
    assert {(r.v1, r.v2): r.vdm for r in vdm(df).collect()} == {("a", "b"): 2.0, ("a", "c"): 0.0, ("b", "c"): 2.0}
    assert {(r.v1, r.v2) for r in vdm(df, dense=False).collect()} == {("a", "c")}
