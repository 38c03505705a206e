"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens.  A token without a capital or a digit
is itself (lower-cased); numbers, names (capitalised words) and units (after a
number) become typed placeholders whose values are kept as slots.  Windows of
``window`` template tokens with at least ``literals`` tokens that are no
placeholder are hash-joined with those of the benchmark.  For every document, item and
alignment the slots must then be consistent: one value of the item stands for one value
of the document and the other way round (the most frequent counterpart); windows with a
slot that breaks this do not count.  So a re-parameterised question is caught (every 3
became a 7) and a chance meeting of templates is not.  A document is contaminated by an item if the consistent windows of one alignment cover
``min_tokens`` tokens of the item (or all tokens of a shorter one).

Only windows whose hash is in the benchmark leave the scan: the set of those hashes goes
to the tasks if it has at most ``sent_hashes`` entries; a larger one is met by a
shuffled semi-join on the same rows, with the same result.

Edits that change the number of tokens: windows are also taken with every run of names
and every run of numbers and units as one placeholder ("New York" meets "Boston", "60 km"
meets "60km").  Of an item that no single alignment reveals, the windows of one place of
the document (gaps of at most ``GAP`` windows) are chained over all alignments, both
positions ascending; the slots must be consistent over the chain, and its windows must
cover as many tokens.  No token of the document stands for two of the item.

Copies in any case, and items of few literals: the same windows over all words, lower-cased
and without the floor of literals, are met as well, each slot having its own value.  They
count in the chains only, so what typed windows alone reveal keeps its figures.

Defined cases: NULL, empty or blank texts have no windows; items of fewer tokens than
a window are compared as one window of their own length; items without enough
literals match only word by word; repeated rows, also with a NULL key, give one row for each key
and item; other columns are ignored; empty tables give an empty result.  Texts are
read whole, in slices.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .common import release, worker_state

# fixed values: units of measure and written numbers that count as such
UNITS = frozenset("""
mm cm m km in ft yd mi mile miles inch inches foot feet yard yards meter meters metre metres
kilometer kilometers kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms pound
pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds
min minute minutes h hr hour hours day days week weeks month months year years dollar dollars
euro euros cent cents usd eur percent degree degrees mph kmh kb mb gb tb watt watts volt volts
""".split())
NUMBERS = frozenset("""
one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand
million billion
""".split())
LITERAL, NUM, NAME, UNIT, NONE = 0, 1, 2, 3, -1
MARK = np.array([0, 11, 13, 17], dtype=np.uint64)        # hashes of the placeholders
VERBATIM = np.uint64(0xC2B2AE3D27D4EB4F)                 # sets the hashes of plain words apart
BASE = np.uint64(0x9E3779B97F4A7C15)
CACHE = 200_000                                          # words that a worker remembers
SLICE = 1_000_000                                        # characters read at once
GAP = 2                                                  # windows between the parts of a chain
BLANK = re.compile(r"\s")


def canonical(word: str) -> tuple[int, str]:
    """(type, value) of one blank-separated word."""
    core = word.strip(".,;:!?\"'()[]{}*#$%&|<>=+-_/\\~^`@")
    if not core.isalnum():
        core = core.strip()
        while core and not core[0].isalnum():
            core = core[1:]
        while core and not core[-1].isalnum():
            core = core[:-1]
    if not core:
        return NONE, ""
    low = core.lower()
    if core[0].isdigit() or low in NUMBERS:
        return NUM, low
    if core[0].isupper():
        return NAME, low
    return LITERAL, low


class Lexicon(dict):
    """Raw word -> row of the arrays ``kind``, ``value`` (a hash) and ``unit``."""

    def __init__(self):
        super().__init__()
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.kind = np.zeros(1024, np.int8)
        self.value = np.zeros(1024, np.uint64)
        self.unit = np.zeros(1024, bool)

    def __missing__(self, word: str) -> int:
        kind, value = canonical(word)
        i = len(self)
        if i == len(self.kind):                          # twice the room
            self.kind, self.value, self.unit = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.kind, self.value, self.unit))
        self.kind[i], self.unit[i] = kind, value in UNITS
        self.value[i] = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"))
        self[word] = i
        return i

    def ids(self, words: list[str]) -> np.ndarray:
        """Rows of the words; valid until the next call."""
        if len(self) > CACHE:
            self._reset()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def parts(text: str) -> Iterator[str]:
    """Slices of about SLICE characters, cut at white space."""
    at = 0
    while len(text) - at > SLICE and (gap := BLANK.search(text, at + SLICE)):
        yield text[at:gap.start()]
        at = gap.start()
    yield text[at:]


class Template:
    """The template tokens of some texts, one after the other; ``bounds`` are the texts' borders.
    Words are looked up again when a window is shown."""

    def __init__(self, texts: list[str | None], lexicon: Lexicon):
        self.parts, kinds, values, units, text_of = [], [], [], [], []
        for t, text in enumerate(texts):
            for x in parts(text or ""):
                ids = lexicon.ids(x.split())
                kind = lexicon.kind[ids]
                if (kind == NONE).any():
                    ids, kind = ids[kind != NONE], kind[kind != NONE]
                self.parts.append(x)
                text_of.append(t)
                kinds.append(kind)
                values.append(lexicon.value[ids])
                units.append(lexicon.unit[ids])
        sizes = [len(k) for k in kinds]
        self.first = np.cumsum([0, *sizes])
        self.text = np.repeat(np.array(text_of, np.int64), sizes)
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.kind, value = np.concatenate(kinds), np.concatenate(values)
        opens = np.ones(len(self.kind), bool)            # the first token of a text
        opens[1:] = self.text[1:] != self.text[:-1]
        after = np.zeros(len(self.kind), bool)
        after[1:] = (self.kind[:-1] == NUM) & ~opens[1:]
        self.kind[after & np.concatenate(units)] = UNIT
        self.literal = self.kind == LITERAL
        self.hash = np.where(self.literal, value, MARK[self.kind])
        self.value = value
        # runs of names, and of numbers with units, as one placeholder
        self.run = np.where(self.kind == UNIT, np.int8(NUM), self.kind)
        self.starts = opens | self.literal
        self.starts[1:] |= self.run[1:] != self.run[:-1]
        self.shown: tuple[int, list[str]] = (-1, [])

    def word(self, i: int) -> str:
        p = int(np.searchsorted(self.first, i, side="right")) - 1
        if self.shown[0] != p:
            found = map(canonical, self.parts[p].split())
            self.shown = p, [value for kind, value in found if kind != NONE]
        return self.shown[1][i - int(self.first[p])]

    def windows(self, n: int, literals: int, known=None) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the windows of n tokens of one text that have enough literals; with
        ``known`` (from hashes to booleans), only of hashes that may be known."""
        pos, h = _windows(self.hash, self.literal, n, literals, known)
        keep = self.text[pos] == self.text[pos + n - 1]
        return pos[keep], h[keep]

    def merged(self, n: int, literals: int, known=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, hashes, tokens) of such windows with a run of several tokens in them."""
        at = np.flatnonzero(self.starts)
        if len(at) == len(self.kind):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        kind = self.run[at]
        pos, h = _windows(np.where(kind == LITERAL, self.hash[at], MARK[kind]), kind == LITERAL,
                          n, literals, known)
        span = np.append(at, len(self.kind))[pos + n] - at[pos]
        keep = np.flatnonzero((span > n) & (self.text[at[pos]] == self.text[at[pos] + span - 1]))
        return at[pos[keep]], h[keep], span[keep]

    def shapes(self, n: int, literals: int, known=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, hashes, tokens) of the windows of all kinds; 0 tokens for words as such."""
        pos, h = self.windows(n, literals, known)
        at, plain = self.verbatim(n, known)
        found = ((pos, h, np.full(len(pos), n)), self.merged(n, literals, known),
                 (at, plain, np.zeros(len(at), np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def verbatim(self, n: int, known=None) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of all windows of n lower-cased words."""
        pos, h = _windows(self.value, None, n, 0, known and (lambda x: known(x ^ VERBATIM)))
        keep = self.text[pos] == self.text[pos + n - 1]
        return pos[keep], h[keep] ^ VERBATIM

    def describe(self, at: int, n: int, span: int | None = None) -> tuple[str, list[dict]]:
        """The template as text, and its slots; runs are merged if ``span`` is not ``n``, and
        words are shown as such, behind a mark, if it is 0."""
        if span == 0:
            words = [self.word(i) for i in range(at, at + n)]
            return "= " + " ".join(words), [{"k": k, "kind": int(self.kind[at + k]), "value": x}
                                            for k, x in enumerate(words) if self.kind[at + k] != LITERAL]
        text, slots = [], []
        merge = span is not None and span != n
        for i in range(at, at + (n if span is None else span)):
            kind, word = int(self.run[i] if merge else self.kind[i]), self.word(i)
            if merge and i > at and not self.starts[i]:
                slots[-1]["value"] += word if self.kind[i] == UNIT else " " + word
                continue
            text.append(word if kind == LITERAL else f"<{kind}>")
            if kind != LITERAL:
                slots.append({"k": i - at, "kind": kind, "value": word})
        return " ".join(text), slots


def _windows(tokens: np.ndarray, literal: np.ndarray | None, n: int, literals: int,
             known=None) -> tuple[np.ndarray, np.ndarray]:
    if len(tokens) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(tokens) - n + 1
    # hashes of 1, 2, 4, ... tokens make those of n, the leftmost token having the highest power
    total, done, part, size, power = np.zeros(m, np.uint64), 0, tokens, 1, np.array([BASE])
    left = n
    while left:
        if left & 1:
            total = total * power + part[done:done + m]
            done += size
        left >>= 1
        if left:
            part = part[:-size] * power + part[size:]
            size, power = 2 * size, power * power
    total ^= total >> np.uint64(29)
    keep = np.arange(m) if known is None else np.flatnonzero(known(total))
    if literals and len(keep):
        count = np.concatenate([[0], np.cumsum(literal)])
        keep = keep[count[keep + n] - count[keep] >= literals]
    return keep, total[keep]


def _groups(keys: list, column: pa.Array) -> Iterator[tuple[list, list]]:
    """Keys and texts in groups of about SLICE characters."""
    some, texts, size = [], [], 0
    for key, x in zip(keys, column, strict=True):
        some.append(key)
        texts.append(x.as_py())
        size += len(texts[-1] or "")
        if size >= SLICE:
            yield some, texts
            some, texts, size = [], [], 0
    if some:
        yield some, texts


def _need(n: int, window: int, literals: int) -> int:
    return literals if n == window else -(-n * literals // window)


def item_windows(items: DataFrame, item: str, text: str, window: int, literals: int) -> DataFrame:
    """``(item, n_tokens, n, hash, j, item_span, template, slots)`` of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, rows = Lexicon(), []
        for b in batches:
            for key, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = Template([x], lexicon)
                if len(t.kind) == 0:
                    continue
                n = min(window, len(t.kind))
                short = min(window, int(t.starts.sum()))
                pos, h = t.windows(n, _need(n, window, literals))
                found = [(n, *x, n) for x in zip(pos.tolist(), h.tolist(), strict=True)]
                found += [(short, *x) for x in zip(
                    *(a.tolist() for a in t.merged(short, _need(short, window, literals))), strict=True)]
                found += [(n, *x, 0) for x in zip(*(a.tolist() for a in t.verbatim(n)), strict=True)]
                for size, j, v, span in found:
                    shape, slots = t.describe(j, size, span)
                    rows.append((key, len(t.kind), size, v - 2**64 if v >= 2**63 else v, j, span,
                                 shape, slots))
        cols = list(zip(*rows, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, _TYPES, strict=True)], _NAMES)

    kind = items.schema[item].dataType.simpleString()
    _TYPES = [None, pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(),
              pa.list_(pa.struct([("k", pa.int32()), ("kind", pa.int32()), ("value", pa.string())]))]
    _TYPES[0] = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    _NAMES = ["item", "n_tokens", "n", "hash", "j", "item_span", "template", "slots"]
    return (items.select(F.col(item).alias("_i"), F.col(text).alias("_x"))
            .mapInArrow(run, f"item {kind}, n_tokens int, n int, hash long, j int, item_span int, "
                             "template string, slots array<struct<k:int,kind:int,value:string>>"))


def _scan(docs: DataFrame, text: str, sizes: list[int], window: int, literals: int,
          known: np.ndarray | None) -> DataFrame:
    """``(content, n, hash, i, span, template, slots)``: windows of the texts, only those with a
    known hash if ``known`` is given; ``content`` is the text's hash."""
    spark = docs.sparkSession
    sent = None if known is None else spark.sparkContext.broadcast(np.sort(known.view(np.uint64)))
    names = ["content", "n", "hash", "i", "span", "template", "slots"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(),
             pa.list_(pa.struct([("k", pa.int32()), ("kind", pa.int32()), ("value", pa.string())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, table, known = worker_state("decontaminate", Lexicon), None, None
        if sent is not None:
            table = sent.value
            quick = np.zeros(1 << 20, bool)
            quick[(table >> np.uint64(44)).astype(np.int64)] = True

            def known(h):
                return quick[(h >> np.uint64(44)).astype(np.int64)]
        for keys, texts in (x for b in batches for x in _groups(b.column(0).to_pylist(), b.column(1))):
            rows = []
            t = Template(texts, lexicon)
            for n in sizes:
                pos, h, span = t.shapes(n, _need(n, window, literals), known)
                if table is not None and len(pos):
                    p = np.minimum(np.searchsorted(table, h), len(table) - 1)
                    hit = table[p] == h
                    pos, h, span = pos[hit], h[hit], span[hit]
                of = t.text[pos]
                for at, d, i, v, m in zip(pos.tolist(), of.tolist(), (pos - t.bounds[of]).tolist(),
                                          h.view(np.int64).tolist(), span.tolist(), strict=True):
                    rows.append((keys[d], n, v, i, m, *t.describe(at, n, m)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
        release()

    return (docs.select(F.xxhash64(F.col(text)).alias("_c"), F.col(text).alias("_x"))
            .mapInArrow(run, "content long, n int, hash long, i int, span int, "
                             "template string, slots array<struct<k:int,kind:int,value:string>>"))


def _join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL being equal to NULL; the keys of ``a`` stay."""
    b = b.withColumnsRenamed({c: "_k_" + c for c in keys})
    out = a.join(b, [a[c].eqNullSafe(b["_k_" + c]) for c in keys], how)
    return out.drop(*["_k_" + c for c in keys])


def _segments(wins: list[tuple]) -> list[list[tuple]]:
    """Windows of one alignment that touch are one segment; merged ones stand alone."""
    out, last = [], {}
    for w in wins:
        i, span, j, item_span = w[:4]
        part = last.get(i - j) if span == item_span else None
        if part is not None and i <= part[-1][0] + part[-1][1]:
            part.append(w)
            continue
        out.append([w])
        if span == item_span:
            last[i - j] = out[-1]
    return sorted(out, key=lambda x: (x[0][0], x[-1][0] + x[-1][1], x[0][2], x[-1][2] + x[-1][3]))


def _gain(i0, i1, j0, j1, slack, i_end, j_end):
    """Item tokens that [j0, j1) adds after j_end, if [i0, i1) has as many after i_end."""
    return np.minimum(j1 - np.maximum(j0, j_end), i1 - np.maximum(i0, i_end) + slack)


def _chains(parts: list[list[tuple]], reach: int, need: int) -> Iterator[list[tuple]]:
    """Chains of segments, both positions ascending, that cover most; no segment twice."""
    i0, j0 = (np.array([x[0][k] for x in parts]) for k in (0, 2))
    i1, j1 = (np.array([x[-1][k] + x[-1][k + 1] for x in parts]) for k in (0, 2))
    slack = np.maximum(0, (j1 - j0) - (i1 - i0))
    best, before = (j1 - j0).astype(float), np.full(len(parts), -1)
    first = np.searchsorted(i0, i0 - reach - int((i1 - i0).max()))
    for b in range(len(parts)):
        a = slice(first[b], b)
        gain = _gain(i0[b], i1[b], j0[b], j1[b], slack[b], i1[a], j1[a])
        fits = ((i1[a] >= i0[b] - reach) & (i1[a] <= i1[b]) & (j0[a] <= j0[b])
                & (j1[a] <= j1[b]) & (gain > 0))
        if fits.any():           # of equal chains the one with the smaller jumps
            jump = np.abs((i0[b] - j0[b]) - (i1[a] - j1[a]))
            total = np.where(fits, best[a] + gain - 0.5 * jump / (1 + jump) / len(parts), -1)
            if total.max() > best[b]:
                before[b], best[b] = first[b] + int(total.argmax()), total.max()
    used = np.zeros(len(parts), bool)
    for b in np.argsort(-best, kind="stable").tolist():
        if best[b] <= need - 1:
            break
        chain = []
        while b >= 0 and not used[b]:
            used[b] = True
            chain.append(parts[b])
            b = int(before[b])
        if chain:
            yield [w for x in reversed(chain) for w in x]


def _consistent(chain: list[tuple]) -> tuple[int, int]:
    """(covered item tokens, replaced values) of the windows whose slots agree."""
    pairs = [[(p["k"] + w[2], p["kind"], q["value"], p["value"])
              for p, q in zip(w[5], w[4], strict=True)] for w in chain]
    votes = Counter((kind, mine, theirs) for x in pairs for _, kind, mine, theirs in x)
    mine_of, theirs_of = {}, {}
    for (kind, mine, theirs), n in votes.items():
        theirs_of[kind, mine] = max(theirs_of.get((kind, mine), (0, "")), (n, theirs))
        mine_of[kind, theirs] = max(mine_of.get((kind, theirs), (0, "")), (n, mine))
    covered = i_end = j_end = 0
    plain, merged = {}, {}
    for (i, span, j, item_span, *_), x in zip(chain, pairs, strict=True):
        if any(theirs_of[kind, mine][1] != theirs or mine_of[kind, theirs][1] != mine
               for _, kind, mine, theirs in x):
            continue
        gain = int(_gain(i, i + span, j, j + item_span, max(0, item_span - span), i_end, j_end))
        if gain > 0:
            covered, i_end, j_end = covered + gain, max(i_end, i + span), max(j_end, j + item_span)
        (plain if span == item_span else merged).update((p, v) for p, *v in x)
    return covered, len({tuple(v) for v in (merged | plain).values() if v[1] != v[2]})


def _chained(pairs: DataFrame, window: int, min_tokens: int) -> DataFrame:
    """``(content, item, covered, item_tokens, replaced)`` of the chains that cover enough."""
    kind = pairs.schema["item"].dataType.simpleString()
    schema = f"content long, item {kind}, covered int, item_tokens int, replaced int"
    found = (pairs.groupBy("content", "item")
             .agg(F.max("n_tokens").alias("item_tokens"),
                  (F.max(F.expr("j + item_span")) - F.min("j")).alias("width"),
                  F.collect_list(F.struct("i", "span", "j", "item_span", "slots",
                                          "item_slots")).alias("wins"))
             .where(F.col("width") >= F.least(F.lit(min_tokens), F.col("item_tokens")))
             .select("content", "item", "item_tokens", "wins"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            picked, figures = [], []
            for at in range(b.num_rows):
                size = b.column(2)[at].as_py()
                need = min(min_tokens, size)
                wins = sorted((tuple(w.values()) for w in b.column(3)[at].as_py()),
                              key=lambda w: (w[0], w[1], w[2], w[3]))
                for chain in _chains(_segments(wins), GAP * window, need):
                    covered, replaced = _consistent(chain)
                    if covered >= need:
                        picked.append(at)
                        figures.append((covered, size, replaced))
                        break
            rows = b.select([0, 1]).take(pa.array(picked, pa.int64()))
            cols = list(zip(*figures, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, *(pa.array(c, pa.int32()) for c in cols)],
                ["content", "item", "covered", "item_tokens", "replaced"])

    return found.mapInArrow(run, schema)


def contaminated_contents(docs: DataFrame, items: DataFrame, *, text: str = "text",
                          item: str = "item_id", item_text: str = "text", window: int = 8,
                          literals: int = 5, min_tokens: int = 13,
                          sent_hashes: int = 1_000_000) -> DataFrame:
    """``(content, item, covered_tokens, item_tokens, replaced_slots)``: contaminated texts."""
    ship_package(docs.sparkSession)
    bench = cut_lineage(item_windows(items, item, item_text, window, literals))
    sizes = sorted(r.n for r in bench.select("n").distinct().collect())   # at most ``window``
    keys = bench.select("hash").distinct()
    few = keys.limit(sent_hashes + 1).count() <= sent_hashes
    known = np.array([r.hash for r in keys.collect()], np.int64) if few else None
    hits = _scan(docs, text, sizes, window, literals, known)
    if not few:
        hits = hits.join(keys, "hash", "left_semi")
    hits = cut_lineage(hits.dropDuplicates(["content", "n", "i", "span"]))
    every = hits.join(bench.withColumnRenamed("slots", "item_slots"), ["n", "hash", "template"])
    pairs = (every.where((F.col("span") == F.col("n")) & (F.col("item_span") == F.col("n"))
                         & (F.col("n") == F.least(F.lit(window), F.col("n_tokens"))))
             .withColumn("shift", F.col("i") - F.col("j")))
    line = ["content", "item", "shift"]
    slot = (pairs.select(*line, "i", F.explode(F.arrays_zip("slots", "item_slots")).alias("z"))
            .select(*line, "i", F.col("z.slots.kind").alias("kind"),
                    F.col("z.slots.value").alias("mine"), F.col("z.item_slots.value").alias("theirs")))
    # what each value stands for in this alignment: its most frequent counterpart, either way
    votes = slot.groupBy(*line, "kind", "mine", "theirs").agg(F.count(F.lit(1)).alias("n"))
    agreed = votes
    for a, b in (("mine", "theirs"), ("theirs", "mine")):
        first = votes.groupBy(*line, "kind", a).agg(F.max(F.struct("n", b))[b].alias("_" + b))
        agreed = _join(agreed, first, [*line, "kind", a])
    odd = agreed.where("_mine <> mine OR _theirs <> theirs").select(*line, "kind", "mine", "theirs")
    bad = _join(slot, odd, [*line, "kind", "mine", "theirs"]).select(*line, "i").distinct()
    cover = (_join(pairs, bad, [*line, "i"], "left_anti")
             .withColumn("token", F.explode(F.sequence("j", F.expr("j + n - 1")))))
    changed = (agreed.where("_mine = mine AND _theirs = theirs AND mine <> theirs").groupBy(*line)
               .agg(F.count(F.lit(1)).cast("int").alias("replaced")))
    found = (cover.groupBy(*line)
             .agg(F.count_distinct("token").cast("int").alias("covered"),
                  F.max("n_tokens").alias("item_tokens"))
             .where(F.col("covered") >= F.least(F.lit(min_tokens), F.col("item_tokens"))))
    found = _join(found, changed, line, "left")
    # of several alignments the one that covers most, and then replaces least
    best = F.max(F.struct("covered", (-F.coalesce("replaced", F.lit(0))).alias("kept")))
    single = cut_lineage(
        found.groupBy("content", "item")
        .agg(best.alias("best"), F.max("item_tokens").alias("item_tokens"))
        .select("content", "item", F.col("best.covered").alias("covered_tokens"), "item_tokens",
                (-F.col("best.kept")).alias("replaced_slots")))
    # a window of plain words has n tokens, and the item's values in its slots
    plain = F.col("span") == 0
    every = every.select("content", "item", "n_tokens", "i", "j", "item_slots",
                         F.when(plain, F.col("item_slots")).otherwise(F.col("slots")).alias("slots"),
                         *(F.when(plain, F.col("n")).otherwise(F.col(c)).alias(c)
                           for c in ("span", "item_span")))
    rest = _join(every, single.select("content", "item"), ["content", "item"], "left_anti")
    return single.union(_chained(rest, window, min_tokens))


def contaminations(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text",
                   item: str = "item_id", **options) -> DataFrame:
    """``(key, item, covered_tokens, item_tokens, replaced_slots)`` of contaminated documents."""
    found = contaminated_contents(docs, items, text=text, item=item, **options)
    return (docs.select(key, F.xxhash64(F.col(text)).alias("content")).join(found, "content")
            .select(key, F.col("item").alias(item), "covered_tokens", "item_tokens",
                    "replaced_slots").distinct())


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that an item contaminates."""
    found = contaminated_contents(docs, items, text=text, **options)
    bad = found.select(F.col("content").alias("_content")).distinct()
    return (docs.withColumn("_content", F.xxhash64(F.col(text)))
            .join(bad, "_content", "left_anti").drop("_content"))
