"""Periodic runs of words in whole texts, found by recompression.

The words of a run of texts become numbers, and the numbers a run-length
grammar: equal neighbours are put together as blocks (a, k), then letters are
dealt to two sides and each left one followed by a right one becomes a pair, and
so on until no letter occurs twice. Equal letters stand for equal words, so the
longest common extension of two places is read off the grammar in leaps: the
largest letters that both places begin (or end) with, blocks in one leap.

A run of period q covers four periods, so the places i and i + q lie in it for
some i on the grid of 3 q. Pairs of that harmonic grid whose words are equal, and
one of whose neighbours are, are extended to both sides; what is long enough is a
run, and the least period that gave it is its own. No suffix array is built, and
all extensions of a run of texts are asked at once.

Defined results: null and empty texts have no words and no runs; equal rows have
equal results; rows without an id are rows like others; an empty table gives no
rows; other columns are ignored. A text is held whole by one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import ship

#: A run covers so many periods, and so many words.
PERIODS, WORDS = 4, 6
#: Pairs of the grid that are looked at together.
SLAB = 1_000_000


class Grammar:
    """A run-length grammar of a sequence of numbers below ``kinds``; those from ``single`` on occur once and are never paired."""

    def __init__(self, symbols: np.ndarray, single: int, kinds: int):
        self.n = len(symbols)
        #: words that a letter stands for, by letter
        self.width = np.ones(kinds, np.int64)
        #: the highest level at which a letter begins at a place
        self.top = np.zeros(self.n + 1, np.int64)
        self._levels: list[tuple] = []
        start, quiet, turn = np.arange(self.n), 0, 0
        bounds = np.zeros(kinds, bool)
        bounds[single:] = True
        self._add(symbols, start)
        while quiet < 8 and len(np.unique(symbols)) < len(symbols):
            made = self._blocks(symbols, start)
            if made is not None:
                symbols, start = made
                bounds = np.append(bounds, np.zeros(len(self.width) - len(bounds), bool))
                self._add(symbols, start)
            made = self._pairs(symbols, start, bounds, turn)
            turn, quiet = turn + 1, 0 if made is not None else quiet + 1
            if made is not None:
                symbols, start = made
                bounds = np.append(bounds, np.zeros(len(self.width) - len(bounds), bool))
                self._add(symbols, start)
        self.place, self.letter, self.ahead, self.behind = (np.concatenate(x) for x in zip(*self._levels, strict=True))
        self._levels = []

    def _add(self, symbols: np.ndarray, start: np.ndarray) -> None:
        level = len(self._levels)
        self.top[start] = level
        self.top[self.n] = level
        m = len(symbols)
        first = np.ones(m + 1, bool)
        first[1:m] = symbols[1:] != symbols[:-1]
        edge = np.flatnonzero(first)
        size = np.diff(edge)
        behind = np.arange(m) - np.repeat(edge[:-1], size) + 1
        ahead = np.repeat(size, size) - behind + 1
        # each level ends with a letter that equals none
        self._levels.append((level * (self.n + 1) + np.append(start, self.n), np.append(symbols, -1), np.append(ahead, 1), np.append(behind, 1)))

    def _named(self, at: np.ndarray, code: np.ndarray, width: np.ndarray, symbols: np.ndarray) -> None:
        """Gives new letters, a code each, to the places."""
        _, one, name = np.unique(code, return_index=True, return_inverse=True)
        symbols[at] = name + len(self.width)
        self.width = np.append(self.width, width[one])

    def _blocks(self, symbols: np.ndarray, start: np.ndarray):
        """Equal neighbours as one letter (a, k)."""
        edge = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        if len(edge) == len(symbols):
            return None
        size = np.diff(np.append(edge, len(symbols)))
        out, many = symbols[edge], np.flatnonzero(size > 1)
        a, k = out[many], size[many]
        self._named(many, a * (self.n + 1) + k, self.width[a] * k, out)
        return out, start[edge]

    def _pairs(self, symbols: np.ndarray, start: np.ndarray, bounds: np.ndarray, turn: int):
        """Each letter of the left side that one of the right side follows, with it as one letter."""
        kinds = len(self.width)
        side = (K.mix64(np.arange(kinds, dtype=np.uint64) + np.uint64(turn << 40)) & np.uint64(1)).astype(bool)
        left = ~(side | bounds)[symbols[:-1]] & (side & ~bounds)[symbols[1:]]
        at = np.flatnonzero(left)
        if not len(at):
            return None
        a, b = symbols[at], symbols[at + 1]
        out = symbols.copy()
        self._named(at, a * kinds + b, self.width[a] + self.width[b], out)
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        return out[keep], start[keep]

    def extension(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from i < j on (back: before them) are equal."""
        out = np.zeros(len(i), np.int64)
        open_, level = np.arange(len(i)), np.minimum(self.top[i], self.top[j])
        run, step = (self.behind, -1) if back else (self.ahead, 1)
        i, j = i.copy(), j.copy()
        while len(open_):
            x = np.searchsorted(self.place, level * (self.n + 1) + i) - back
            y = np.searchsorted(self.place, level * (self.n + 1) + j) - back
            same = self.letter[x] == self.letter[y]
            leap = np.where(same, np.minimum(run[x], run[y]) * self.width[self.letter[x]], 0)
            out[open_] += leap
            i, j = i + step * leap, j + step * leap
            level = np.where(same, np.minimum(self.top[i], self.top[j]), level - 1)
            on = level >= 0
            open_, i, j, level = open_[on], i[on], j[on], level[on]
        return out


def grid(n: int, periods: int):
    """(i, q) of the harmonic grid of n words, in slabs."""
    q = np.arange(1, n // periods + 1)
    count = (n - 1 - q) // ((periods - 1) * q) + 1
    total, done = np.cumsum(count), 0
    while done < len(q):
        to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + SLAB, "right")))
        c, p = count[done:to], q[done:to]
        nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        p = np.repeat(p, c)
        yield nth * (periods - 1) * p, p
        done = to


def runs_of(words: np.ndarray, at: np.ndarray, periods: int = PERIODS, least: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, in this order; ``words`` are numbers, ``at`` the offsets of the texts."""
    if periods < 3:
        raise ValueError("a run covers three periods at least")
    none = np.zeros(0, np.int64)
    seen_text, seen_i, seen_q = [], [], []
    for t in range(len(at) - 1):
        w = words[at[t] : at[t + 1]]
        if len(w) < least:
            continue
        # a number that equals none at both ends
        w = np.concatenate([[-1], w, [-2]])
        for i, q in grid(len(w) - 2, periods):
            hit = w[i + 1] == w[i + q + 1]
            i, q = i[hit], q[hit]
            hit = (w[i] == w[i + q]) | (w[i + 2] == w[i + q + 2])
            i, q = i[hit], q[hit]
            if len(i):
                seen_text.append(np.full(len(i), t))
                seen_i.append(i)
                seen_q.append(q)
    if not seen_i:
        return none, none, none, none
    text, i, q = np.concatenate(seen_text), np.concatenate(seen_i), np.concatenate(seen_q)
    # the grammar of the texts with pairs, each after a letter of its own
    busy = np.unique(text)
    size = at[busy + 1] - at[busy]
    begin = np.cumsum(size + 1) - size
    symbols = np.empty(int((size + 1).sum()), np.int64)
    letters, numbers = np.unique(np.concatenate([words[at[t] : at[t + 1]] for t in busy]), return_inverse=True)
    inside = np.ones(len(symbols), bool)
    inside[begin - 1] = False
    symbols[inside], symbols[begin - 1] = numbers, len(letters) + np.arange(len(busy))
    g = Grammar(symbols, len(letters), len(letters) + len(busy))
    i = i + begin[np.searchsorted(busy, text)]
    found = []
    for lo in range(0, len(i), SLAB):
        a, p, t = i[lo : lo + SLAB], q[lo : lo + SLAB], text[lo : lo + SLAB]
        start = a - g.extension(a, a + p, back=True)
        end = a + p + g.extension(a, a + p)
        long = end - start >= np.maximum(least, periods * p)
        found.append(np.unique(np.stack([t[long], start[long], (end - start)[long], p[long]]), axis=1))
    text, start, length, period = np.unique(np.concatenate(found, axis=1), axis=1)
    # a stretch is found again with multiples of its period
    own = np.ones(len(text), bool)
    own[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, period = text[own], start[own], length[own], period[own]
    start = start - begin[np.searchsorted(busy, text)]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    return np.cumsum(cover[:n]) == 0


def _found(rewrite: Callable[[int, int], np.ndarray | None] | None, periods: int, least: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for i, j, data, at in K.chunks(texts):
                x = K.Texts(data, at)
                begin, end, words = x.words()
                number = np.unique(x.hashes(begin, end), return_inverse=True)[1]
                # the words that each text is taken to consist of
                take = np.arange(len(number))
                for t, d in enumerate(ids.slice(i, j - i).to_pylist() if rewrite else []):
                    n = int(words[t + 1] - words[t])
                    other = rewrite(d, n) if n and d is not None else None
                    if other is not None:
                        take[words[t] : words[t + 1]] = words[t] + other
                text, start, length, period = runs_of(number[take], words, periods, least)
                of = np.searchsorted(text, np.arange(j - i + 1))
                raw, collapsed = data.tobytes(), []
                for t in range(j - i):
                    mine = raw[at[t] : at[t + 1]].split()
                    w = take[words[t] : words[t + 1]] - words[t]
                    runs = slice(of[t], of[t + 1])
                    keep = kept_words(len(w), start[runs], length[runs], period[runs]) if of[t] < of[t + 1] else None
                    if keep is not None or (rewrite and len(w) and (w[-1] != len(w) - 1 or (np.diff(w) != 1).any())):
                        mine = [mine[k] for k in (w if keep is None else w[keep])]
                    collapsed.append(b" ".join(mine))
                runs = pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in (start, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(np.diff(words)), pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), runs), pc.cast(pa.array(collapsed, pa.binary()), pa.string(), safe=False)],
                    ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, periods: int = PERIODS, least: int = WORDS, rewrite: Callable[[int, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start) and the text without repetitions, its words joined by a space.

    rewrite: (doc_id, n) to the places of the words that the text is taken to consist of, or None for its own."""
    ship(docs.sparkSession)
    slim = docs.select("doc_id", "text")
    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(_found(rewrite, periods, least), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: int, n: int) -> np.ndarray | None:
    """Repetitions in a tenth of the documents, as a function of the id."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op13(docs: DataFrame) -> DataFrame:
    found = periodic_runs(docs, rewrite=planted)
    # the first of the runs with the greatest exponent, compared exactly; runs are in the order of start and period
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    told = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("b.length"), F.col("b.period")
    return found.select("doc_id", "n_runs", "b.start", length.alias("length"), period.alias("period"), F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
