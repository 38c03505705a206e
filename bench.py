"""Benchmark of the headline jobs.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line with per-stage seconds.
Each stage is forced with a ``noop`` write so the whole plan executes without
collecting results.  Stages: VDM fit, kNN search + vote, rule fit
(leave-self-out search, rules, rule VDM), ensemble-of-adaptations classify
with metrics, a 10-repetition kNN hold-out, and kNN on the events case base
(the largest search: every query against 70% of the events table), and the
orders case base, all categorical, searched on distinct profiles.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from casebase.operators import evaluate as E  # noqa: E402
from casebase.operators.classify import adapt_classify, knn_classify  # noqa: E402
from casebase.operators.prepare import holdout_sides  # noqa: E402
from casebase.plans import jobs  # noqa: E402
from casebase.plans.model import CaseModel  # noqa: E402
from casebase.session import local_session  # noqa: E402
from casebase.sources import casebases as CB  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, max(8, int(cpus) * 2) if cpus.isdigit() else 16, app="bench")
    times: dict[str, float] = {}
    info: dict[str, int] = {}

    def timed(name, fn):
        t = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t, 3)
        return out

    spec, train, test = jobs.sides(spark, sf_dir, "docs")
    info["docs_train"], info["docs_test"] = train.count(), test.count()
    m = timed("vdm_fit_docs", lambda: CaseModel.fit(train, spec))
    timed("knn_classify_docs", lambda: run(knn_classify(test, m, jobs.K)))
    mr = timed("rule_fit_docs", lambda: m.with_rules(jobs.RADIUS))
    info["rules"] = mr.rules.count()
    timed("adapt_classify_docs",
          lambda: run(E.metrics(adapt_classify(test, mr, jobs.K, jobs.RNO))))

    def holdout():
        s, cases = CB.docs(spark, sf_dir)
        tr, te = holdout_sides(cases, s.id, jobs.REPS)
        hm = CaseModel.fit(tr, s, by=["rep"])
        run(E.metrics(knn_classify(te, hm, jobs.K), ["rep"]))
    timed("holdout_knn_docs_10reps", holdout)

    espec, etrain, etest = jobs.sides(spark, sf_dir, "evt")
    info["evt_train"], info["evt_test"] = etrain.count(), etest.count()
    em = timed("vdm_fit_evt", lambda: CaseModel.fit(etrain, espec))
    timed("knn_classify_evt", lambda: run(knn_classify(etest, em, jobs.K)))

    ospec, otrain, otest = jobs.sides(spark, sf_dir, "ord")
    info["ord_train"], info["ord_test"] = otrain.count(), otest.count()
    om = timed("vdm_fit_ord", lambda: CaseModel.fit(otrain, ospec))
    timed("knn_classify_ord_profiles", lambda: run(knn_classify(otest, om, jobs.K)))
    omr = timed("rule_fit_ord_profiles", lambda: om.with_rules(jobs.RADIUS))
    timed("adapt_classify_ord",
          lambda: run(E.metrics(adapt_classify(otest, omr, jobs.K, jobs.RNO))))

    total = round(sum(times.values()), 3)
    pairs = info["evt_train"] * info["evt_test"]
    print(json.dumps({
        "metric": "total_sec", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": cpus, "sizes": info,
        "evt_knn_pairs_per_sec": round(pairs / times["knn_classify_evt"]),
    }))


if __name__ == "__main__":
    main()
