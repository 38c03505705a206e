"""Delimited readers: the layouts over files that the tests write."""

import pytest

from casebase.operators.prepare import drop_missing
from casebase.operators.stats import class_counts, sigma
from casebase.sources.delimited import CATALOGUE, read_delimited


def _lines(name, n=60):
    """``n`` lines of a layout: numbers in numeric columns, few values in the others."""
    ds = CATALOGUE[name]
    rows = []
    for i in range(n):
        rows.append([f"{i * 1.5 + j}" if c in ds.numeric else
                     (f"L{i % ds.classes}" if c == ds.label else f"v{(i + j) % 4}")
                     for j, c in enumerate(ds.columns)])
    return ds, rows


def _write(path, rows, end="\n"):
    path.write_bytes(end.join(",".join(r) for r in rows).encode() + end.encode())
    return str(path)


@pytest.mark.parametrize("name", sorted(CATALOGUE))
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_layouts(spark, tmp_path, name, end):
    ds, rows = _lines(name)
    df = read_delimited(spark, _write(tmp_path / "x.data", rows, end), ds)
    assert df.columns == [*ds.columns, "case_id"]
    got = sorted(tuple(str(v) for v in r)[:-1] for r in df.collect())
    assert got == sorted(tuple(str(float(v)) if c in ds.numeric else v
                               for c, v in zip(ds.columns, r, strict=True)) for r in rows)
    assert ds.classes == class_counts(df, ds.spec()).count()
    assert {r.feature: r.sigma for r in sigma(df, ds.spec()).collect()} == dict(ds.sigma)


def test_fields(spark, tmp_path):
    ds = CATALOGUE["balance"]
    rows = [['"b', 'c"', "", "4", "5"], ["a", "2", "", "", ""], ["a", "2", "3", "4", "5", "more", "x"],
            [" a ", "'", "3", "4", "5"]]
    df = read_delimited(spark, _write(tmp_path / "x.data", [*rows, [""]]), ds, id_col=None)
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[:5]) for r in rows)


def test_bad_lines_fail(spark, tmp_path):
    few = read_delimited(spark, _write(tmp_path / "few.data", [["a", "b"]]), CATALOGUE["balance"])
    with pytest.raises(Exception, match="fewer than 5 fields"):
        few.collect()
    ds, rows = _lines("credit", 3)
    rows[1][1] = "number"
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_delimited(spark, _write(tmp_path / "bad.data", rows), ds).collect()


def test_key_depends_on_content_alone(spark, tmp_path):
    ds, rows = _lines("car")
    rows = rows + rows[:7] + rows[:3]
    one = read_delimited(spark, _write(tmp_path / "one.data", rows), ds)
    (tmp_path / "many").mkdir()
    for i in range(4):
        _write(tmp_path / "many" / f"{i}.data", rows[::-1][i::4])
    many = read_delimited(spark, str(tmp_path / "many"), ds)
    a, b = ({r.case_id: tuple(r)[:-1] for r in df.collect()} for df in (one, many))
    assert a == b and len(a) == len(rows)


def test_drop_missing_marker(spark):
    df = spark.createDataFrame([("a", "1"), ("?", "2"), ("b", "?"), ("c", None)], "x string, y string")
    assert sorted(tuple(r) for r in drop_missing(df).collect()) == [("a", "1")]
