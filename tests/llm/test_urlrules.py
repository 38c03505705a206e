"""URL rules: parts, policy, mined rules against brute force, plan."""

from itertools import combinations

from pyspark.sql import functions as F

from casebase.llm import urlrules as U
from casebase.llm.queries import URL_POLICY

URLS = ["http://WWW.Example.org/es/1?x=1#y", "https://example.org/en/15", "https://example.org/en/25",
        "http://a.com/fr/x", "http://a.com/de/x", "http://a.com/it/", "http://notorg/", "http://x.org",
        "http://x.org/", "no scheme", None, "", "://", "http://A.COM/De/", "http://a.com/de/?q=://b.org/",
        "http://b.net/1", "x://É.org/é"]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host):].split("?", 1)[0].split("#", 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    best = (None, None)
    for site, v in URL_POLICY:
        h, p = site.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = max(best, (site, v), key=lambda x: len(x[0] or ""))
    return best


def test_parts_and_policy(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[0], "y")],
                                  "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in U.judge(pages, labels, URL_POLICY).collect()}
    assert len(got) == len(URLS) + 1
    for i, u in enumerate(URLS):
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow")


def test_mined_rules_like_brute_force(spark):
    rows = []
    for i in range(240):
        host = ["spam.net", "www.good.net", "ads.good.net", "shop.net"][i % 4]
        path = ["en", "fr", "promo"][i % 3]
        rows.append((i, f"https://{host}/{path}/{i}?id={i}" if i % 7 else f"http://{host}/{path}"))
    bad = lambda i: int(i % 4 == 0 or (i % 4 == 3 and i % 3 == 2))
    labelled = [(i, 1 - bad(i), 0) for i in range(0, 200)] + [(7, None, None), (None, 0, 1)]
    rows += [(500, rows[0][1]), (500, rows[0][1]), (501, "https://new.net/promo/x"), (502, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    options = {"max_tokens": 2, "min_confidence": 0.8, "min_count": 10}
    got = {(r.page_id, r.verdict) for r in U.judge(pages, labels, [], **options).collect()}

    tokens = {r._url: set(r.tokens) for r in U.url_tokens(U.url_parts(
        pages.select(F.col("url").alias("_url")), "_url"), "_url").collect()}
    train = [(tokens[u], bad(i)) for i, u in rows if i < 200]
    names = sorted(set().union(*(t for t, _ in train)))
    rules = []
    for combo in [*combinations(names, 1), *combinations(names, 2)]:
        hits = [b for t, b in train if set(combo) <= t]
        if sum(hits) >= 10 and sum(hits) / len(hits) >= 0.8:
            rules.append(set(combo))
    assert any(len(r) == 2 for r in rules)
    want = {(i, "block" if any(r <= tokens[u] for r in rules) else "allow") for i, u in rows}
    assert got == want and {"block", "allow"} == {v for _, v in got}


def test_no_python_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    df = U.judge(pages, labels, URL_POLICY)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Cartesian" not in plan
    assert U.judge(pages.where(F.lit(False)), labels, URL_POLICY).count() == 0


def test_rules_of_more_than_two_tokens(spark):
    """Bad only if host, path and query name meet; no two of them reach the confidence."""
    rows, labelled, i = [], [], 0
    for host in ("x.net", "y.net"):
        for path in ("p", "q"):
            for query in ("a", "b"):
                for _ in range(30):
                    rows.append((i, f"http://{host}/{path}?{query}={i}"))
                    labelled.append((i, int((host, path, query) != ("x.net", "p", "a")), 0))
                    i += 1
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in U.judge(pages, labels, []).collect()}
    assert got == {k: "block" if u.startswith("http://x.net/p?a=") else "allow" for k, u in rows}
    tokens = U.url_tokens(U.url_parts(pages.select("page_id", F.col("url").alias("_url")), "_url"), "_url")
    mined = U.mine(tokens.join(labels, tokens.page_id == labels.doc_id)
                   .select("tokens", (F.col("quality") == 0).alias("bad"))).collect()
    assert [r.tokens for r in mined] == [["host=x.net", "path=p", "query=a"]]


def test_toxic_rows_without_quality_are_learned(spark):
    pages = spark.createDataFrame([(i, f"http://{'xy'[i % 2]}.net/{i}") for i in range(80)],
                                  "page_id long, url string")
    labels = spark.createDataFrame([(i, None if i % 2 == 0 else 1, 1 if i % 2 == 0 else None)
                                    for i in range(80)] + [(1, None, None), (3, 7, None)],
                                   "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in U.judge(pages, labels, []).collect()}
    assert got == {i: "allow" if i % 2 else "block" for i in range(80)}


def test_copies_of_a_long_url_end_soon(spark):
    """Thirty path segments on the same rows are one item; any of them blocks."""
    long = "http://a.b.spam.net/" + "/".join(f"s{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30))
    rows = [(i, long if i < 1000 else f"http://good{i % 7}.net/sx/{i}") for i in range(2000)]
    pages = spark.createDataFrame([*rows, (5000, "http://new.org/saa/1"), (5001, "http://new.org/other")],
                                  "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 1000), 0) for i in range(2000)],
                                   "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in U.judge(pages, labels, []).collect()}
    assert got == {i: "block" if i < 1000 or i == 5000 else "allow" for i in [*range(2000), 5000, 5001]}


def test_tokens_on_the_same_rows_stand_for_each_other(spark):
    """Bad where two pairs of inseparable tokens meet: one of each pair blocks, in any combination."""
    rows, labelled, i = [], [], 0
    for host in ("x.net", "y.net"):
        for path in ("p/pp", "q/qq"):
            for _ in range(30):
                rows.append((i, f"http://{host}/{path}"))
                labelled.append((i, int((host, path) != ("x.net", "p/pp")), 0))
                i += 1
    new = {i: "http://x.net/p", i + 1: "http://x.net/pp", i + 2: "http://x.net/z", i + 3: "http://z.net/p"}
    pages = spark.createDataFrame(rows + list(new.items()), "page_id long, url string")
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in U.judge(pages, labels, []).collect()}
    assert [got[k] for k in new] == ["block", "block", "allow", "allow"]
    assert {k for k in range(i) if got[k] == "block"} == {k for k, _, _ in labelled if k < 30}


def test_support_is_the_same_at_every_size(spark):
    """25 bad rows of a host make a rule among 10,000 labelled rows and among 60,000."""
    for n in (10_000, 60_000):
        pages = spark.range(n).select(F.col("id").alias("page_id"), F.when(F.col("id") < 25, "http://spam.net/")
                                      .otherwise(F.concat(F.lit("http://h"), F.col("id") % 90, F.lit(".org/")))
                                      .alias("url"))
        labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") >= 25).cast("int").alias("quality"),
                                       F.lit(0).alias("toxic"))
        got = U.judge(pages, labels, []).where("verdict = 'block'").select("page_id").collect()
        assert sorted(r.page_id for r in got) == list(range(25))
