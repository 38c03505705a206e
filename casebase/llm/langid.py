"""Language ID: known words first, then back off to shorter character n-grams.

A word that the model knows scores by its per-language log frequency.  For an
unseen word the longest n-gram length with a known n-gram counts: the mean of
the log frequencies of its known n-grams of that length.  A text's language is
the one with the largest sum over all its words; the score is that language's
share after a softmax of the sums.

The model is fitted on a sample of at most about ``fit_rows`` labelled rows
(a documented bound, drawn by key hash and shared evenly among the languages: those with
few rows give all) and holds at most ``max_cells`` table cells, so what is sent to the tasks is
bounded.  Beyond that bound every language and n-gram length keeps equally many of its most
frequent entries, so frequent languages don't push out rare ones.  Every word of every text is scored.

Defined cases: a NULL text or one without a letter is ``und`` with score 0, and
so is everything if there are no labelled rows; a text whose letters the model
has never seen gets the first language with an even score; equal sums go to the first
language in order; repeated rows are repeated; other columns of the input are
never read; an empty table gives an empty result.  Long texts are read in slices.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .common import release, worker_state

UND = "und"
SLICE = 1_000_000            # characters read at once
CACHE = 100_000              # scored words that a worker remembers
ALPHA = 0.5                  # added to every count


def slices(text: str, find_gap) -> Iterator[str]:
    """Parts of about SLICE characters, cut where no word goes on."""
    at = 0
    while len(text) - at > SLICE:
        gap = find_gap(text, at + SLICE)
        if gap is None:
            break
        yield text[at:gap.start()]
        at = gap.start()
    yield text[at:] if at else text


def _patterns():
    import regex
    return regex.compile(r"\p{L}+").findall, regex.compile(r"\P{L}").search


def _count_grams(rows: DataFrame, lang: str, text: str, n_max: int) -> DataFrame:
    """``(lang, n, gram, count)``: n = 0 for whole words, 1..n_max for n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("langid")
        words, gap = _patterns()
        for b in batches:
            by_lang: dict[str, Counter] = {}
            for code, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for part in slices(x, gap):
                    by_lang.setdefault(code, Counter()).update(words(part.lower()))
            for code, seen in by_lang.items():
                grams: Counter = Counter()
                for w, c in seen.items():
                    grams[0, w] += c
                    for n in range(1, n_max + 1):
                        for i in range(len(w) - n + 1):
                            grams[n, w[i:i + n]] += c
                yield pa.RecordBatch.from_arrays(
                    [pa.array([code] * len(grams), pa.string()),
                     pa.array([n for n, _ in grams], pa.int32()),
                     pa.array([g for _, g in grams], pa.string()),
                     pa.array(list(grams.values()), pa.int64())], ["lang", "n", "gram", "count"])

    return (rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
            .mapInArrow(run, "lang string, n int, gram string, count long")
            .groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")))


class Model:
    """Log frequencies: ``index[n][gram]`` is a row of ``table`` (grams x languages)."""

    def __init__(self, langs: list[str], index: list[dict[str, int]], table: np.ndarray):
        self.langs, self.index, self.table = langs, index, table

    def word(self, w: str) -> np.ndarray:
        """The scores of one lower-case word."""
        i = self.index[0].get(w)
        if i is not None:
            return self.table[i]
        for n in range(min(len(self.index) - 1, len(w)), 0, -1):
            known = self.index[n]
            rows = [known[g] for g in (w[i:i + n] for i in range(len(w) - n + 1)) if g in known]
            if rows:
                return self.table[rows].mean(axis=0)
        return np.zeros(len(self.langs))


def sample_by_language(rows: DataFrame, key: str, lang: str, bound: int) -> DataFrame:
    """``rows`` if they are at most ``bound``, else about ``bound`` by key hash, as evenly from the
    languages as their rows allow.  The number of languages reaches the driver, a row each."""
    sizes = sorted((r.n, r.code) for r in rows.groupBy(F.col(lang).alias("code"))
                   .agg(F.count(F.lit(1)).alias("n")).collect())
    if sum(n for n, _ in sizes) <= bound:
        return rows
    left, cuts = bound, []
    for i, (n, code) in enumerate(sizes):
        take = min(n, left // (len(sizes) - i))
        left -= take
        cuts.append((code, -(-2**31 * take // n)))
    cut = rows.sparkSession.createDataFrame(cuts, "_code string, _cut long")
    part = (rows.join(F.broadcast(cut), F.col(lang).cast("string") == F.col("_code"))
            .where(F.pmod(F.xxhash64(F.col(key)), F.lit(2**31)) < F.col("_cut")).drop("_code", "_cut"))
    m = part.count()                         # one key may hold most rows
    return part if m <= 2 * bound else part.where(F.rand(7) < bound / m)


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang",
        n_max: int = 4, min_count: int = 2, fit_rows: int = 8_000,
        max_cells: int = 800_000) -> Model:
    """Learn from the labelled rows of ``docs`` (the caller leaves out held-out ones)."""
    ship_package(docs.sparkSession)
    rows = sample_by_language(docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
                              .select(key, lang, text), key, lang, fit_rows)
    counts = cut_lineage(_count_grams(rows, lang, text, n_max))
    sums = {(r.n, r.lang): (r.s, r.v) for r in
            counts.groupBy("n", "lang").agg(F.sum("count").alias("s"),
                                            F.count(F.lit(1)).alias("v")).collect()}
    langs = sorted({x for _, x in sums})
    if not langs:
        return Model([], [{} for _ in range(n_max + 1)], np.zeros((0, 0)))
    # one row a gram with its counts by language; up to the bound, those that come first in the list
    # of a language and length
    entries = max(1, max_cells // len(langs))
    place = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("count"), "gram"))
    per_gram = (counts.withColumn("place", place).groupBy("n", "gram")
                .agg(F.sum("count").alias("total"), F.min("place").alias("place"),
                     F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("by"))
                .where((F.col("total") >= min_count) | (F.col("n") == 1))
                .orderBy("place", "n", "gram").limit(entries))
    got = per_gram.collect()
    index: list[dict[str, int]] = [{} for _ in range(n_max + 1)]
    table = np.empty((len(got), len(langs)))
    size = [sum(v for (m, _), (_, v) in sums.items() if m == n) for n in range(n_max + 1)]
    for i, r in enumerate(got):
        index[r.n][r.gram] = i
        table[i] = [np.log((r.by.get(x, 0) + ALPHA)
                           / (sums.get((r.n, x), (0, 0))[0] + ALPHA * size[r.n])) for x in langs]
    return Model(langs, index, table)


class _Rows(dict):
    """Word -> row of ``self.table``; scores a word when it is first met."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.table = np.zeros((1024, len(model.langs)))

    def __missing__(self, w: str) -> int:
        i = len(self)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[i] = self.model.word(w)
        self[w] = i
        return i


def predict_texts(model: Model, texts: Iterable[str | None], rows: _Rows | None = None):
    """``(languages, scores)`` of a list of texts."""
    words, gap = _patterns()
    rows = _Rows(model) if rows is None else rows
    names, scores = [], []
    for x in texts:
        total, letters = np.zeros(len(model.langs)), False
        for part in slices(x or "", gap):
            found = words(part.lower())
            if found and model.langs:
                letters = True
                if len(rows) > CACHE:
                    rows.clear()
                ids = np.fromiter(map(rows.__getitem__, found), np.int64, len(found))
                total += rows.table[ids].sum(axis=0)
        if not letters:
            names.append(UND)
            scores.append(0.0)
            continue
        best = int(total.argmax())
        names.append(model.langs[best])
        scores.append(float(1.0 / np.exp(total - total[best]).sum()))
    return names, scores


def language_of(model: Model, text: Column) -> Column:
    """The language of a text, as a struct ``(lang_pred, score)``.  Tasks get the texts alone; the other
    columns of a row stay where they are."""
    spark = SparkSession.getActiveSession()
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_state("langid")
        rows = _Rows(sent.value)
        for b in batches:
            lang, score = predict_texts(sent.value, (x.as_py() for x in b), rows)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             ["lang_pred", "score"])
        del rows
        release()
    return F.arrow_udf(run, "struct<lang_pred:string,score:double>")(text)


def predict(docs: DataFrame, model: Model, *, text: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all if None) with ``lang_pred`` and ``score``,
    which replace columns of the same names."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    found = language_of(model, docs[text])
    return docs.select(*names, found["lang_pred"].alias("lang_pred"), found["score"].alias("score"))


def accepted(docs: DataFrame, model: Model, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``least``, as they are."""
    found = language_of(model, docs[text])
    return docs.where((found["lang_pred"] != UND) & (found["score"] >= least))
