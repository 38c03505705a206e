"""URL filters by association rules, in DataFrame functions and Spark's FP-growth.

A URL's tokens are its scheme, the suffixes of its host, its path segments and query
names (digits as ``#``).  FP-growth over the tokens of the bad labelled URLs finds token
combinations; those of any length (at most ``max_tokens`` tokens if given) on at least ``min_count``
bad rows, whose confidence (bad rows of all labelled rows that hold them) reaches ``min_confidence``
are the rules, without those that hold all tokens of a shorter rule: what they block, it blocks.
The support is a number of rows, the same for tables of every size.

Two things keep the combinations few, without changing what is blocked: tokens on exactly the same
labelled rows (the many segments of one repeated URL) are one item, any of them standing for the
others; and a token that is a rule alone is left out of the mining.  A URL is blocked if it holds all tokens of a rule.  Rules are found by an
inverted index: each is listed under its rarest token, so common tokens such as
``https`` list nothing that a rarer token of the rule can list.

A policy list of (site, verdict) rules decides first; the longest fitting one wins.

Copies of a URL are counted as rows but joined, counted and matched once, so a URL that a third of all
rows repeat costs no more.  What is left to FP-growth are tokens that good URLs hold as well; a URL on
``min_count`` bad rows with many such tokens, each on other rows, still yields all their combinations.

Defined cases: a NULL URL or one without ``://`` has empty host and path, no tokens and
the method's verdict ``allow``; labels other than 0 and 1 are ignored, a row
counts if either of its labels is 0 or 1; a URL with any bad label is bad; without labels there are no mined rules; repeated rows are
repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK = 1000                              # copies of a token set that are dealt together


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _rest() -> Column:
    """What follows the first ``://`` of the column ``_u``, else NULL."""
    return F.when(F.instr("_u", "://") > 0, F.expr("substring(`_u`, instr(`_u`, '://') + 3)"))


def url_parts(rows: DataFrame, url: str) -> DataFrame:
    """``rows`` with ``host`` and ``path``."""
    rest = _rest()
    return (rows.withColumn("_u", F.col(url))
            .withColumn("host", F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)),
                                           F.lit("")))
            .withColumn("path", F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))
            .drop("_u"))


def url_tokens(rows: DataFrame, url: str) -> DataFrame:
    """``rows`` (with ``host`` and ``path``) with the array of distinct ``tokens``."""
    query = F.regexp_extract(_rest(), r"^[^?#]*\?([^#]*)", 1)
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    suffixes = F.when(F.size(labels) > 0, F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    part = lambda c, by, name, cut: F.transform(
        F.filter(F.split(c, by), lambda x: x != ""),
        lambda x: F.concat(F.lit(name), F.regexp_replace(F.regexp_extract(x, cut, 0), "[0-9]+", "#")))
    none = F.array().cast("array<string>")
    tokens = F.concat(
        F.when(F.instr("_u", "://") > 0,
               F.array(F.concat(F.lit("scheme="), lower_ascii(F.substring_index("_u", "://", 1))))),
        F.coalesce(suffixes, none), part(F.col("path"), "/", "path=", r"(?s)^.*$"),
        part(query, "&", "query=", r"^[^=]*"))
    return (rows.withColumn("_u", F.col(url))
            .withColumn("tokens", F.coalesce(F.array_distinct(tokens), none)).drop("_u"))


def _weighted(labelled: DataFrame) -> DataFrame:
    """``(tokens, n, b)``: distinct token sets with their rows and bad rows, so that the copies of one URL
    are one row."""
    return cut_lineage(labelled.groupBy(F.array_sort("tokens").alias("tokens")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("b"))
        .where(F.size("tokens") > 0))


def _items(weighted: DataFrame, min_count: int) -> DataFrame:
    """``(item, alike, n, b)``: the tokens with enough bad rows; those on exactly the same rows are one
    item, named by the first of them.  Equal rows are told by two 64-bit digests."""
    digest = [F.xxhash64("tokens", F.lit(i)).alias(f"d{i}") for i in (1, 2)]
    same = [F.bit_xor(f"d{i}").alias(f"d{i}") for i in (1, 2)]
    return cut_lineage(
        weighted.select(F.explode("tokens").alias("token"), "n", "b", *digest)
        .groupBy("token").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), *same)
        .where(F.col("b") >= min_count)
        .groupBy("d1", "d2", "n", "b").agg(F.array_sort(F.collect_list("token")).alias("alike"))
        .select(F.col("alike")[0].alias("item"), "alike", "n", "b"))


def _combinations(weighted: DataFrame, items: DataFrame, min_count: int) -> DataFrame | None:
    """``(tokens, n, b)`` of the combinations of at least two ``items``, by FP-growth on the bad rows;
    ``n`` is counted on all rows."""
    rows = cut_lineage(
        weighted.withColumn("token", F.explode("tokens"))
        .join(items.select("item", F.explode("alike").alias("token")), "token")
        .groupBy("tokens", "n", "b").agg(F.array_sort(F.collect_set("item")).alias("items"))
        .groupBy("items").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        .where(F.size("items") > 1))
    total = rows.agg(F.sum("b")).first()[0] or 0
    if total < min_count:
        return None
    # FP-growth has no weights: a set comes as often as it has bad rows, dealt in chunks
    bad = (rows.where(F.col("b") > 0)
           .select("items", "b", F.explode(F.expr(f"sequence(0, (b - 1) div {CHUNK})")).alias("chunk"))
           .repartition(F.xxhash64("items", "chunk"))
           .select("items", F.explode(F.expr(f"sequence(1, least({CHUNK}, b - chunk * {CHUNK}))")).alias("i")))
    model = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / total).fit(bad.select("items"))
    sets = cut_lineage(model.freqItemsets.where(F.size("items") > 1)
                       .select(F.array_sort("items").alias("tokens"), F.col("freq").alias("b")))
    listed = (sets.withColumn("item", F.explode("tokens")).join(items.select("item", "n"), "item")
              .groupBy("tokens", "b").agg(F.min(F.struct("n", "item"))["item"].alias("item")))
    counts = (rows.select("items", "n", F.explode("items").alias("item")).join(listed, "item")
              .where(F.size(F.array_except("tokens", "items")) == 0)
              .groupBy("tokens", "b").agg(F.sum("n").alias("n")))
    return counts.select("tokens", "n", "b")


def mine(labelled: DataFrame, *, max_tokens: int | None = None, min_confidence: float = 0.8,
         min_count: int = 20) -> DataFrame:
    """``(tokens, confidence, alike, listed)`` of the rules from ``labelled(tokens, bad boolean)``:
    ``alike`` holds for each of the ``tokens`` those on the same labelled rows, any of which stands for it;
    ``listed`` those of the token that the fewest labelled rows have."""
    weighted = _weighted(labelled)
    items = _items(weighted, min_count)
    sure = F.col("b").cast("double") / F.col("n") >= min_confidence
    found = items.where(sure).select(F.array("item").alias("tokens"), "n", "b")
    if max_tokens is None or max_tokens > 1:
        # what holds a rule of one token goes, so those tokens are left out
        more = _combinations(weighted, items.where(~sure), min_count)
        if more is not None:
            if max_tokens is not None:
                more = more.where(F.size("tokens") <= max_tokens)
            found = found.unionByName(more.where(sure))
    place = F.sort_array(F.collect_list(F.struct("item", "alike")))
    listed = cut_lineage(
        found.select("tokens", (F.col("b").cast("double") / F.col("n")).alias("confidence"),
                     F.explode("tokens").alias("item"))
        .join(items.select("item", "alike", "n"), "item").groupBy("tokens", "confidence")
        .agg(F.transform(place, lambda x: x["alike"]).alias("alike"),
             F.min(F.struct("n", "item", "alike"))["alike"].alias("listed")))
    # by length: what holds a kept rule goes; that one is listed under one of the tokens
    for (size,) in sorted(listed.select(F.size("tokens")).distinct().collect())[:-1]:
        kept = (listed.where(F.size("tokens") == size)
                .select(F.col("listed")[0].alias("token"), F.col("tokens").alias("part")))
        idle = (listed.where(F.size("tokens") > size)
                .select("tokens", F.explode("tokens").alias("token")).join(kept, "token")
                .where(F.size(F.array_except("part", "tokens")) == 0).select("tokens").distinct())
        listed = cut_lineage(listed.join(idle, "tokens", "left_anti").select(listed.columns))
    return listed


def matched(urls: DataFrame, rules: DataFrame, url: str) -> DataFrame:
    """The distinct ``url`` of ``urls(url, tokens)`` that hold all tokens of a rule."""
    one = urls.select(url, "tokens").dropDuplicates([url])
    return (one.withColumn("token", F.explode("tokens"))
            .join(rules.select(F.explode("listed").alias("token"), "alike"), "token")
            .where(F.forall("alike", lambda c: F.arrays_overlap(c, F.col("tokens"))))
            .select(url).distinct())


def policy(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting (site, verdict) rule for ``host`` and ``path``."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for site, v in sorted(rules, key=lambda r: (len(r[0]), len(r[0].partition("/")[0]), r[0])):
        host, slash, path = site.partition("/")
        host = host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) \
            & F.startswith(F.col("path"), F.lit(slash + path))
        rule, verdict = F.when(fits, F.lit(site)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], *,
          key: str = "page_id", url: str = "url", label_key: str = "doc_id",
          quality: str = "quality", toxic: str = "toxic", **options) -> DataFrame:
    """``(key, host, path, rule, verdict)`` of every page."""
    bad = F.max(((F.col(quality) == 0) | (F.col(toxic) == 1)).cast("int")) == 1
    known = (labels.where(F.col(quality).isin(0, 1) | F.col(toxic).isin(0, 1)).groupBy(F.col(label_key).alias("_k")).agg(
        F.coalesce(bad, F.lit(False)).alias("bad")))
    rows = url_parts(pages.select(F.col(key).alias("_k"), F.col(url).alias("_url")), "_url")
    tokens = url_tokens(rows, "_url")
    mined = mine(tokens.join(known, "_k").select("tokens", "bad"), **options)
    hits = matched(tokens, mined, "_url").withColumn("hit", F.lit(True))
    rule, verdict = policy(rules)
    return (rows.join(hits, "_url", "left")
            .select(F.col("_k").alias(key), "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")))
                    .alias("verdict")))
