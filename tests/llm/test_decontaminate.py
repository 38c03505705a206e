"""Template decontamination: re-parameterised questions, slots, odd rows, brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebase.llm import decontaminate as D

ITEM = ("A train leaves Boston at 3 and travels 60 miles each hour while another one leaves "
        "Denver at 5 and travels 40 miles each hour until both of them meet near Boston")
SAME = ITEM.replace("Boston", "Paris").replace("Denver", "Rome").replace("60", "75").replace("3", "9")
WALK = "if Ann gives Ann some cake then Ann has more than Ann had before Ann came to see Ann there"
NAMES = iter("Bob Cid Dan Eve Fay Gus".split())
MIXED = re.sub("Ann", lambda _: next(NAMES), WALK)       # Ann became six people
UNITS = ITEM.replace("miles", "kilometers")


def _run(spark, docs, items, **options):
    a = spark.createDataFrame(docs, "doc_id long, text string, content string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in D.contaminations(a, b, **options).collect()), key=str)


def test_canonical():
    assert D.canonical("Boston,") == (D.NAME, "boston") and D.canonical("(60)") == (D.NUM, "60")
    assert D.canonical("travels") == (D.LITERAL, "travels") and D.canonical("--") == (D.NONE, "")
    assert D.canonical("Three") == (D.NUM, "three") and D.canonical("3.5%")[0] == D.NUM
    t = D.Template(["60 miles of miles"], D.Lexicon())
    assert t.kind.tolist() == [D.NUM, D.UNIT, D.LITERAL, D.LITERAL]


def test_cases(spark):
    pad = "some other words that nobody has ever asked about in this place "
    docs = [(1, pad + ITEM + ". " + pad, "x"), (2, pad + SAME, None), (3, pad + MIXED, "x"), (11, pad + WALK.replace("Ann", "Joe"), "x"),
            (4, pad * 4, "x"), (5, None, "x"), (6, "", "x"), (7, pad + UNITS, "x"), (None, ITEM, "q"),
            (None, ITEM, "r"), (8, "Bo " * 60, "x"), (9, " ".join(ITEM.split()[:12]), "x"),
            (10, pad * 30_000 + ITEM + " " + pad * 1000, "y")]
    items = [(100, ITEM), (101, None), (102, ""), (103, "Is Bob in town"), (104, "what is it called"),
             (105, WALK)]
    got = _run(spark, docs, items)
    n = len(ITEM.split())
    assert {(d, i) for d, i, *_ in got} == {(1, 100), (2, 100), (7, 100), (None, 100), (10, 100), (11, 105)}
    assert len(got) == 6
    by = {d: (c, m, s) for d, _, c, m, s in got}
    assert by[1] == (n, n, 0) and by[2] == (n, n, 4) and by[11][2] == 1 and by[7][2] >= 1
    # item 104 is shorter than a window: it is found as a whole
    assert [(d, i) for d, i, *_ in _run(spark, [(1, "so what is it called today", "x")], items)] == [(1, 104)]


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_like_brute_force(spark, sent):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{c}" for c in "abcdefghijklmnop"] + ["Tom", "Ann", "Bob", "7", "19", "km"]
    text = lambda n: " ".join(rng.choice(vocabulary, n).tolist())
    items = [(i, text(int(rng.integers(3, 40)))) for i in range(12)]
    docs = []
    for i in range(60):
        body = text(40)
        if i % 2:
            words = items[i % 12][1].split()
            at = int(rng.integers(0, max(1, len(words) - 10)))
            body += " " + " ".join(words[at:]) + " " + text(10)
        if i % 6 == 1:
            body = body.replace("Tom", "Eve").replace("19", "23")
        docs.append((i, body, "x"))
    got = {(d, i, c) for d, i, c, *_ in _run(spark, docs, items, window=5, literals=3, min_tokens=7,
                                              sent_hashes=sent)}
    assert got == brute(docs, items, 5, 3, 7) and len(got) > 15


def brute(docs, items, window, literals, least):
    """Every window of every document against every window of every item."""
    def tokens(text):
        out = []
        for w in text.split():
            kind, value = D.canonical(w)
            if kind != D.NONE:
                unit = kind == D.LITERAL and value in D.UNITS and out and out[-1][0] == D.NUM
                out.append((D.UNIT if unit else kind, value))
        return out

    found = set()
    for item, text in items:
        b = tokens(text)
        n = min(window, len(b))
        need = literals if n == window else -(-n * literals // window)
        for doc, body, _ in docs:
            a = tokens(body)
            lines = {}
            for i in range(len(a) - n + 1):
                for j in range(len(b) - n + 1):
                    shape = [(k, v if k == D.LITERAL else None) for k, v in a[i:i + n]]
                    if shape == [(k, v if k == D.LITERAL else None) for k, v in b[j:j + n]] \
                            and sum(k == D.LITERAL for k, _ in shape) >= need:
                        lines.setdefault(i - j, []).append((i, j))
            covered = 0
            for met in lines.values():
                slots = Counter((a[i + k][0], a[i + k][1], b[j + k][1]) for i, j in met
                                for k in range(n) if a[i + k][0] != D.LITERAL)
                ok = {(t, x, y) for (t, x, y) in slots
                      if (slots[t, x, y], y) == max((c, q) for (u, p, q), c in slots.items() if (u, p) == (t, x))
                      and (slots[t, x, y], x) == max((c, p) for (u, p, q), c in slots.items() if (u, q) == (t, y))}
                covered = max(covered, len({j + k for i, j in met for k in range(n) if all(
                    a[i + m][0] == D.LITERAL or (a[i + m][0], a[i + m][1], b[j + m][1]) in ok
                    for m in range(n))}))
            if covered and covered >= min(least, len(b)):
                found.add((doc, item, covered))
    return found


def test_decontaminate_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, ITEM, "a"), (2, "clean words", "b"), (None, None, None), (2, "clean words", "b")],
                                 "doc_id long, text string, _x string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = D.decontaminate(docs, items)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [2, 2, None]
    assert D.decontaminate(docs, items.where(F.lit(False))).count() == 4
    assert D.decontaminate(docs.where(F.lit(False)), items).count() == 0


def test_slices_change_nothing(monkeypatch):
    text = " ".join(f"w{i % 37} N{i % 5} {i} km" for i in range(300))
    whole = D.Template([text], D.Lexicon())
    monkeypatch.setattr(D, "SLICE", 50)
    monkeypatch.setattr(D, "CACHE", 20)
    cut = D.Template([text], D.Lexicon())
    assert len(cut.parts) > 50
    assert (cut.kind == whole.kind).all() and (cut.hash == whole.hash).all()
    assert cut.describe(100, 8) == whole.describe(100, 8)


def _found(spark, texts, item=ITEM, **options):
    """The numbers of the texts in which the item is found."""
    pad = "some other words that nobody has ever asked about in this place "
    docs = [(k, pad + x + " " + pad, "x") for k, x in enumerate(texts)]
    return {d for d, *_ in _run(spark, docs, [(1, item)], **options)}


SHORT = "the fast train from Boston needs about 60km of free track before it can stop there safely"


def test_edits_that_change_the_number_of_tokens(spark):
    middle = "a passage of many plain old words that another word in the middle cuts in two equal parts"
    assert _found(spark, [middle.replace("another", "another short"),
                          middle.replace("another ", "")], middle) == {0, 1}
    texts = [SHORT.replace("Boston", "New York"), SHORT.replace("60km", "60 km"),
             SHORT.replace("60km", "sixty five km"),
             SHORT.replace("Boston", "New York").replace("60km of", "60km or so of"),
             SHORT.replace("Boston", "Salt Lake City").replace("60km", "75 km")]
    assert _found(spark, texts, SHORT) == {0, 1, 2, 3, 4}
    assert _found(spark, texts, SHORT, sent_hashes=0) == {0, 1, 2, 3, 4}
    assert _found(spark, [SHORT], SHORT.replace("Boston", "New York")) == {0}


def test_chains_are_of_one_place_in_order_and_consistent(spark):
    a = "first we look at all the old red houses near"
    b = "then they walk along a long green river again"
    pad = " some other words that nobody has ever asked about in this place" * 3 + " "
    item = a + " " + b
    assert _found(spark, [a + " and " + b, b + " and " + a, a + pad + b, a], item) == {0}
    # one repeated phrase of the document does not stand for three of the item
    phrase = "over and over we go round "
    assert _found(spark, [phrase * 2, phrase * 6], phrase * 6) == {1}
    # six people for one, with an inserted word
    assert _found(spark, [MIXED.replace("cake", "good cake"),
                          WALK.replace("Ann", "Joe").replace("cake", "good cake")], WALK) == {1}


def test_copies_in_any_case_and_items_of_few_literals(spark):
    assert _found(spark, [ITEM.upper(), ITEM.title(), ITEM.lower(), ITEM.upper().replace("ANOTHER", "AN OTHER")]) \
        == {0, 1, 2, 3}
    sums = "12 + 7 = 19, 3 + 4 = 7, 25 + 30 = 55, 8 + 9 = 17"
    other = sums.replace("7", "6").replace("5", "1")
    assert _found(spark, [sums, other], sums) == {0}
    assert _found(spark, [sums, other], sums, sent_hashes=0) == {0}
    names = "Ann Bob Cid Dan Eve Fay Gus Hal Ida"
    assert _found(spark, [names, names.lower(), names.replace("Eve", "Joe")], names) == {0, 1}
