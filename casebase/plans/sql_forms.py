"""Plain-SQL forms of the registered jobs, used as correctness oracles.

Every form is ordinary SQL over the driver's tables (DuckDB dialect where it
matters: ``chr(1)``, list indexing ``embedding[i]``, ``range``).  It follows
the textbook definitions directly: dense VDM over every pair of seen values
and every class, distance terms written out feature by feature, ranking by
``row_number()``.  A group column ``g`` carries the repetition (0 for a
single split) through every step.
"""

from __future__ import annotations

import re

from ..functions.splits import sql_fold, sql_is_train
from ..sources import casebases as CB

ONE = "CAST(1 AS DOUBLE)"
ZERO = "CAST(0 AS DOUBLE)"
SEP = "chr(1)"

_SOURCES = {
    "docs": ("SELECT l.doc_id AS id, l.quality * 2 + l.toxic AS label, "
             "CAST(d.lang AS VARCHAR) AS lang, CAST(d.source AS VARCHAR) AS source, "
             "CAST(d.n_chars AS DOUBLE) AS n_chars "
             "FROM labels l JOIN documents d ON l.doc_id = d.doc_id"),
    "cust": ("SELECT c_custkey AS id, c_mktsegment AS label, "
             "CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal "
             "FROM customer"),
    "evt": ("SELECT event_id AS id, event_type AS label, CAST(hour(ts) AS VARCHAR) AS hour, "
            "CAST(value AS DOUBLE) AS value FROM events"),
    "emb": ("SELECT vec_id AS id, label, " + ", ".join(
        f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(CB.EMB_DIMS))
        + " FROM embeddings"),
    "ord": ("SELECT o_orderkey AS id, o_orderpriority AS label, "
            "CAST(o_orderstatus AS VARCHAR) AS o_orderstatus, "
            "CAST(year(o_orderdate) AS VARCHAR) AS o_year, "
            "CAST(month(o_orderdate) AS VARCHAR) AS o_month FROM orders"),
    "line": ("SELECT CAST(0 AS BIGINT) AS id, l_returnflag AS label, "
             "CAST(l_linestatus AS VARCHAR) AS l_linestatus, "
             "CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(l_tax AS VARCHAR) AS l_tax, "
             "CAST(l_discount AS VARCHAR) AS l_discount FROM lineitem"),
}

_SPECS = {"docs": CB.DOCS, "cust": CB.CUST, "evt": CB.EVT, "emb": CB.EMB, "ord": CB.ORD,
          "line": CB.LINE}


def _rn(part: str, order: str) -> str:
    return f"CAST(row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS INTEGER)"


def _cat_term(q: str, t: str, v: str) -> str:
    return (f"(CASE WHEN {q} = {t} THEN {ZERO} WHEN {v}.vdm IS NULL THEN {ONE} "
            f"ELSE {v}.vdm * {v}.vdm END)")


def _num_term(q: str, t: str, s: str) -> str:
    return (f"(CASE WHEN {s} IS NULL OR {s} = 0 THEN (CASE WHEN {q} = {t} THEN {ZERO} ELSE {ONE} END) "
            f"ELSE least({ONE}, abs({q} - {t}) / (CAST(4 AS DOUBLE) * {s})) END)")


def _vdm_cte(name: str, joint: str, tot: str, cls: str) -> str:
    return (f"{name} AS (SELECT a.g, a.feature, a.value AS v1, b.value AS v2, "
            f"CAST(sum(abs(coalesce(p.n, 0) * b.n - coalesce(q.n, 0) * a.n)) AS DOUBLE) / "
            f"CAST(any_value(a.n) * any_value(b.n) AS DOUBLE) AS vdm "
            f"FROM {tot} a JOIN {tot} b ON a.g = b.g AND a.feature = b.feature AND a.value < b.value "
            f"JOIN {cls} c ON c.g = a.g "
            f"LEFT JOIN {joint} p ON p.g = a.g AND p.feature = a.feature AND p.value = a.value "
            f"AND p.label = c.label "
            f"LEFT JOIN {joint} q ON q.g = b.g AND q.feature = b.feature AND q.value = b.value "
            f"AND q.label = c.label "
            f"GROUP BY a.g, a.feature, a.value, b.value)")


class Forms:
    """SQL builder for one case base; ``reps`` > 0 adds the repetition key."""

    def __init__(self, cb: str, reps: int = 0, k: int = 10, radius: int = 10, rno: int = 10,
                 split: bool = True, folds: int = 0):
        self.cb, self.spec, self.reps, self.folds = cb, _SPECS[cb], reps or folds, folds
        self.k, self.radius, self.rno, self.split = k, radius, rno, split

    # ------------------------------------------------------------- base CTEs
    def base(self) -> list[str]:
        gs = (f"SELECT CAST(range AS INTEGER) AS g FROM range(0, {self.reps})" if self.reps
              else "SELECT 0 AS g")
        train = sql_is_train("cb.id", "gs.g")
        ctes = [f"cb AS ({_SOURCES[self.cb]})", f"gs AS ({gs})"]
        if self.folds:
            fold = sql_fold("cb.id", self.folds)
            ctes += [f"tr AS (SELECT gs.g, cb.* FROM cb CROSS JOIN gs WHERE {fold} <> gs.g)",
                     f"te AS (SELECT gs.g, cb.* FROM cb CROSS JOIN gs WHERE {fold} = gs.g)"]
        elif self.split:
            ctes += [f"tr AS (SELECT gs.g, cb.* FROM cb CROSS JOIN gs WHERE {train})",
                     f"te AS (SELECT gs.g, cb.* FROM cb CROSS JOIN gs WHERE NOT ({train}))"]
        else:
            ctes += ["tr AS (SELECT gs.g, cb.* FROM cb CROSS JOIN gs)"]
        return ctes

    def stats(self) -> list[str]:
        spec, ctes = self.spec, []
        if spec.categorical:
            parts = [f"SELECT g, '{f}' AS feature, {f} AS value, label, count(*) AS n "
                     f"FROM tr GROUP BY g, {f}, label" for f in spec.categorical]
            ctes += [f"jt AS ({' UNION ALL '.join(parts)})",
                     "tot AS (SELECT g, feature, value, CAST(sum(n) AS BIGINT) AS n FROM jt "
                     "GROUP BY g, feature, value)",
                     "cls AS (SELECT DISTINCT g, label FROM tr)",
                     _vdm_cte("vdm", "jt", "tot", "cls")]
        if spec.numeric:
            cols = ", ".join(f"CAST(printf('%.9e', stddev_samp({f})) AS DOUBLE) AS s_{f}" for f in spec.numeric)
            ctes.append(f"sig AS (SELECT g, {cols} FROM tr GROUP BY g)")
        else:
            ctes.append("sig AS (SELECT DISTINCT g FROM tr)")
        return ctes

    def _distance(self, q: str, t: str, vdm: str, tag: str) -> tuple[str, str]:
        """(sum-of-terms expression, LEFT JOIN clauses) in spec order."""
        terms, joins = [], []
        for i, f in enumerate(self.spec.order):
            if self.spec.kind(f) == "cat":
                v = f"{tag}{i}"
                joins.append(f"LEFT JOIN {vdm} {v} ON {v}.g = {q}.g AND {v}.feature = '{f}' "
                             f"AND {v}.v1 = least({q}.{f}, {t}.{f}) "
                             f"AND {v}.v2 = greatest({q}.{f}, {t}.{f})")
                terms.append(_cat_term(f"{q}.{f}", f"{t}.{f}", v))
            else:
                terms.append(_num_term(f"{q}.{f}", f"{t}.{f}", f"s.s_{f}"))
        return " + ".join(terms), " ".join(joins)

    @property
    def profiles(self) -> bool:
        """All features categorical: the SQL compares distinct vectors instead of rows."""
        return not self.spec.numeric

    def _alike(self, a: str, b: str, pa: str = "", pb: str = "") -> str:
        return " AND ".join(f"{a}.{pa}{f} = {b}.{pb}{f}" for f in self.spec.order)

    def _top_by_profile(self, name: str, left: str, right: str, key: str, ids: str, keep: str,
                        k: int, vdm: str) -> list[str]:
        """``{name}_c``: the k best ``right`` rows of every distinct vector of ``left``, by distance
        and ``ids``; only the k first rows of equal vectors can be among them."""
        fs = ", ".join(self.spec.order)
        expr, joins = self._distance("q", "t", vdm, "v")
        qf = ", ".join(f"q.{f} AS q_{f}" for f in self.spec.order)
        tf = ", ".join(f"t.{f} AS t_{f}" for f in self.spec.order)
        part = f"d.g, d.{key}, " + ", ".join(f"d.q_{f}" for f in self.spec.order)
        return [
            f"{name}_r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, {key}, {fs} "
            f"ORDER BY {ids}) AS nth FROM ({right})) WHERE nth <= {k})",
            f"{name}_q AS (SELECT DISTINCT g, {key}, {fs} FROM ({left}))",
            f"{name}_t AS (SELECT DISTINCT g, {key}, {fs} FROM {name}_r)",
            f"{name}_d AS (SELECT q.g, q.{key}, {qf}, {tf}, sqrt({expr}) AS distance FROM {name}_q q "
            f"JOIN {name}_t t ON q.g = t.g AND q.{key} = t.{key} {joins})",
            f"{name}_c AS (SELECT * FROM (SELECT d.*, {keep}, row_number() OVER (PARTITION BY {part} "
            f"ORDER BY distance, {ids}) AS nr FROM {name}_d d JOIN {name}_r r ON r.g = d.g "
            f"AND r.{key} = d.{key} AND {self._alike('r', 'd', '', 't_')}) WHERE nr <= {k})"]

    def knn(self, name: str, k: int, left: str = "te", loo: bool = False) -> list[str]:
        if self.profiles:
            cond = " WHERE q.id <> c.case_id" if loo else ""
            return self._top_by_profile(
                name, f"SELECT *, 0 AS one FROM {left}", "SELECT *, 0 AS one, id AS case_id FROM tr",
                "one", "case_id", "r.case_id", k + 1 if loo else k, "vdm") + [
                f"{name} AS (SELECT * FROM (SELECT q.g, q.id AS query_id, c.case_id, c.distance, "
                f"{_rn('q.g, q.id', 'c.distance, c.case_id')} AS rank FROM {left} q JOIN {name}_c c "
                f"ON c.g = q.g AND {self._alike('q', 'c', '', 'q_')}{cond}) WHERE rank <= {k})"]
        expr, joins = self._distance("q", "t", "vdm", "v")
        cond = " AND q.id <> t.id" if loo else ""
        d = (f"{name}_d AS (SELECT q.g, q.id AS query_id, t.id AS case_id, sqrt({expr}) AS distance "
             f"FROM {left} q JOIN tr t ON q.g = t.g{cond} JOIN sig s ON s.g = q.g {joins})")
        r = (f"{name} AS (SELECT * FROM (SELECT g, query_id, case_id, distance, "
             f"{_rn('g, query_id', 'distance, case_id')} AS rank FROM {name}_d) WHERE rank <= {k})")
        return [d, r]

    def rules(self, radius: int | None = None, sfx: str = "") -> list[str]:
        spec, radius = self.spec, radius or self.radius
        cols = ", ".join(f"a.{f} AS {f}_from, b.{f} AS {f}_to" for f in spec.order)
        lo = f"lo{sfx}"
        ctes = self.knn(lo, radius, left="tr", loo=True)
        # two steps: with all three sides in one, a and b may be joined first, on g alone
        own = ", ".join(f"a.{f}" for f in spec.order)
        ctes.append(
            f"rla{sfx} AS (SELECT {lo}.*, a.label, {own} FROM {lo} JOIN tr a "
            f"ON a.g = {lo}.g AND a.id = {lo}.query_id)")
        ctes.append(
            f"rl{sfx} AS (SELECT a.g, a.query_id AS src_id, a.case_id AS dst_id, "
            f"0 AS direction, a.rank, a.label AS from_label, b.label AS to_label, {cols} "
            f"FROM rla{sfx} a JOIN tr b ON b.g = a.g AND b.id = a.case_id)")
        enc = []
        for f in spec.order:
            if spec.kind(f) == "cat":
                enc.append(f"{f}_from || {SEP} || {f}_to AS {f}")
            else:
                enc.append(f"{f}_from - {f}_to AS {f}")
        ctes.append(
            f"rc{sfx} AS (SELECT g, src_id, dst_id, direction, from_label, to_label, "
            f"CAST(from_label AS VARCHAR) || {SEP} || CAST(to_label AS VARCHAR) AS rule_class, "
            f"{', '.join(enc)} FROM rl{sfx})")
        if spec.categorical:
            parts = [f"SELECT g, '{f}' AS feature, {f} AS value, rule_class AS label, "
                     f"count(*) AS n FROM rc{sfx} GROUP BY g, {f}, rule_class"
                     for f in spec.categorical]
            ctes += [f"rjt{sfx} AS ({' UNION ALL '.join(parts)})",
                     f"rtot{sfx} AS (SELECT g, feature, value, CAST(sum(n) AS BIGINT) AS n "
                     f"FROM rjt{sfx} GROUP BY g, feature, value)",
                     f"rcls{sfx} AS (SELECT DISTINCT g, rule_class AS label FROM rc{sfx})",
                     _vdm_cte(f"rvdm{sfx}", f"rjt{sfx}", f"rtot{sfx}", f"rcls{sfx}")]
        return ctes

    def antecedents(self) -> list[str]:
        spec = self.spec
        enc = []
        for f in spec.order:
            if spec.kind(f) == "cat":
                enc.append(f"b.{f} || {SEP} || q.{f} AS {f}")
            else:
                enc.append(f"b.{f} - q.{f} AS {f}")
        own = ", ".join(f"q.{f}" for f in spec.order)
        return self.knn("nb", self.k) + [
            f"ana AS (SELECT nb.*, {own} FROM nb JOIN te q ON q.g = nb.g AND q.id = nb.query_id)",
            f"an AS (SELECT q.g, q.query_id, q.case_id AS base_id, q.rank AS base_rank, "
            f"b.label AS base_label, {', '.join(enc)} FROM ana q "
            f"JOIN tr b ON b.g = q.g AND b.id = q.case_id)"]

    def retrieval(self, sfx: str = "", rno: int | None = None) -> list[str]:
        """Rule distances of every antecedent to the rules of its base label, top ``rno``."""
        rno = rno or self.rno
        if self.profiles:
            return self._top_by_profile(
                f"rt{sfx}", "SELECT *, base_label AS cls FROM an",
                f"SELECT *, from_label AS cls FROM rc{sfx}", "cls", "src_id, dst_id, direction",
                "r.src_id, r.dst_id, r.direction, r.to_label", rno, f"rvdm{sfx}") + [
                f"rt{sfx} AS (SELECT a.g, a.query_id, a.base_id, a.base_rank, c.src_id, c.dst_id, "
                f"c.direction, c.to_label, c.distance AS rule_distance, CAST(c.nr AS INTEGER) "
                f"AS rule_rank FROM an a JOIN rt{sfx}_c c ON c.g = a.g AND c.cls = a.base_label "
                f"AND {self._alike('a', 'c', '', 'q_')})"]
        expr, joins = self._distance("a", "r", f"rvdm{sfx}", "w")
        return [
            f"rd{sfx} AS (SELECT a.g, a.query_id, a.base_id, a.base_rank, r.src_id, r.dst_id, "
            f"r.direction, r.to_label, sqrt({expr}) AS rule_distance FROM an a "
            f"JOIN rc{sfx} r ON r.g = a.g AND r.from_label = a.base_label "
            f"JOIN sig s ON s.g = a.g {joins})",
            f"rt{sfx} AS (SELECT * FROM (SELECT *, "
            f"{_rn('g, query_id, base_id', 'rule_distance, src_id, dst_id, direction')} "
            f"AS rule_rank FROM rd{sfx}) WHERE rule_rank <= {rno})"]

    def adaptation(self) -> list[str]:
        ctes = self.antecedents() + self.retrieval()
        ctes.append(
            "bv AS (SELECT g, query_id, base_id, to_label AS target FROM (SELECT g, query_id, "
            "base_id, to_label, row_number() OVER (PARTITION BY g, query_id, base_id "
            "ORDER BY count(*) DESC, to_label) AS r FROM rt GROUP BY g, query_id, base_id, "
            "to_label) WHERE r = 1)")
        ctes.append(
            "pv AS (SELECT g, query_id, target AS prediction FROM (SELECT g, query_id, target, "
            "row_number() OVER (PARTITION BY g, query_id ORDER BY count(*) DESC, target) AS r "
            "FROM bv GROUP BY g, query_id, target) WHERE r = 1)")
        ctes.append(
            "pred AS (SELECT te.g, te.id AS query_id, te.label, pv.prediction FROM te "
            "LEFT JOIN pv ON pv.g = te.g AND pv.query_id = te.id)")
        return ctes

    def knn_vote(self) -> list[str]:
        ctes = self.knn("nb", self.k)
        ctes.append(
            "pv AS (SELECT g, query_id, case_label AS prediction FROM (SELECT nb.g, nb.query_id, "
            "t.label AS case_label, row_number() OVER (PARTITION BY nb.g, nb.query_id "
            "ORDER BY count(*) DESC, t.label) AS r FROM nb JOIN tr t ON t.g = nb.g "
            "AND t.id = nb.case_id AND t.label IS NOT NULL GROUP BY nb.g, nb.query_id, t.label) WHERE r = 1)")
        ctes.append(
            "pred AS (SELECT te.g, te.id AS query_id, te.label, pv.prediction FROM te "
            "LEFT JOIN pv ON pv.g = te.g AND pv.query_id = te.id)")
        return ctes

    @staticmethod
    def metrics() -> list[str]:
        w = "(CAST(n_c AS DOUBLE) / CAST(nn AS DOUBLE))"
        p = "(CASE WHEN predc = 0 THEN CAST(0 AS DOUBLE) ELSE tpc / predc END)"
        r = "(tpc / CAST(n_c AS DOUBLE))"
        f1 = f"(CASE WHEN {p} + {r} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(2 AS DOUBLE) * {p} * {r} / ({p} + {r}) END)"
        fpr = ("(CASE WHEN nn = n_c THEN NULL ELSE (predc - tpc) / "
               "CAST(nn - n_c AS DOUBLE) END)")
        return [
            "conf AS (SELECT g, label, prediction, count(*) AS n FROM pred GROUP BY g, label, prediction)",
            "tru AS (SELECT g, label AS c, sum(n) AS n_c FROM conf GROUP BY g, label)",
            "pc AS (SELECT g, prediction AS c, sum(n) AS pred_c FROM conf GROUP BY g, prediction)",
            "tp AS (SELECT g, label AS c, n AS tp FROM conf WHERE label = prediction)",
            "tt AS (SELECT g, sum(n) AS nn FROM conf GROUP BY g)",
            "per AS (SELECT tru.g, tt.nn, tru.n_c, CAST(coalesce(tp.tp, 0) AS DOUBLE) AS tpc, "
            "CAST(coalesce(pc.pred_c, 0) AS DOUBLE) AS predc FROM tru JOIN tt ON tt.g = tru.g "
            "LEFT JOIN pc ON pc.g = tru.g AND pc.c = tru.c "
            "LEFT JOIN tp ON tp.g = tru.g AND tp.c = tru.c)",
            f"mt AS (SELECT g, CAST(max(nn) AS BIGINT) AS n_test, "
            f"CAST(max(nn) - sum(tpc) AS BIGINT) AS n_errors, "
            f"round((max(nn) - sum(tpc)) / max(nn), 9) AS error_rate, "
            f"round(sum({p} * {w}), 9) AS weighted_precision, "
            f"round(sum({r} * {w}), 9) AS weighted_recall, "
            f"round(sum({f1} * {w}), 9) AS weighted_f1, "
            f"round(sum({fpr} * {w}), 9) AS weighted_fpr, "
            f"round(sum({r} * {w}), 9) AS weighted_tpr FROM per GROUP BY g)",
        ]


# small tables that later steps read more than once
_KEPT = re.compile(r"(vdm|lo|nb|rla|rl|rc|ana|an|rjt|rtot|rvdm|rt|(lo|nb|rt)(_\d+)?_[rqtc])(_\d+)? AS \(")


def query(ctes: list[str], select: str) -> str:
    ctes = [c.replace(" AS (", " AS MATERIALIZED (", 1) if _KEPT.match(c) else c for c in ctes]
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _uniq(ctes: list[str]) -> list[str]:
    seen, out = set(), []
    for c in ctes:
        name = c.split(" AS ", 1)[0]
        if name not in seen:
            seen.add(name)
            out.append(c)
    return out
