"""Quality rules by distribution divergence.

Each language has two references, summed over all documents: shares of
character classes, and shares of its most common words (word hashes in 65,536
buckets). A document fails if the Jensen-Shannon distance of its own shares to
its language's reference is too large. Short texts are noisy, so each test has
a least length. References are drawn towards the sum of all languages by
pseudo-counts, so that a rare language has one of its own too. A text without
a language is compared with all references, and the nearest counts.

Defined results: null text is empty and has no words; short texts fail the base
rules; texts that pass them but are too short for a test pass that test; a
language named '' is one like any other, a null one is none; words with equal
counts rank by bucket; equal rows get equal verdicts; an empty table gives no
rows; other columns of the input are ignored by the scores and kept by the
filter; a text is handled whole, however long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import saved, ship

BUCKETS, COMMON = 65_536, 48
#: Largest distances that pass.
CHAR_LIMIT, WORD_LIMIT = 0.32, 0.44
#: Least lengths: characters in words for the first test, words for the second. Below, good texts come near the limits by chance.
LEAST_CHARS, LEAST_WORDS = 200, 60
#: Pseudo-counts from the sum of all languages: characters and words. Fewer than the shortest tested text has, so that no language is too rare.
LENT_CHARS, LENT_WORDS = 50, 10
#: Languages whose references fit into a task (a few kilobytes each); more are an error, none is left out.
LANGUAGES = 5_000
SYMBOLS = b"#*$%&|<>"

CLASSES = 9
_CLASS = np.full(256, 7, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[32], _CLASS[10] = 3, 4
_CLASS[list(b".,;:!?'\"()-")] = 5
_CLASS[list(SYMBOLS)] = 6
_CLASS[192:] = 8
_CONTINUATION = np.zeros(256, bool)
_CONTINUATION[128:192] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def class_counts(t: K.Texts) -> np.ndarray:
    kinds = np.where(_CONTINUATION[t.data], CLASSES, _CLASS[t.data]).astype(np.int64)
    return np.bincount(K.owners(t.at) * (CLASSES + 1) + kinds, minlength=t.n * (CLASSES + 1)).reshape(t.n, CLASSES + 1)[:, :CLASSES]


def word_buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = K.Texts(data, at, lower=True)
    start, end, words = t.words()
    return (t.hashes(start, end) % K.U(BUCKETS)).astype(np.int64), words


def base_counts(t: K.Texts) -> dict[str, np.ndarray]:
    start, end, words = t.words()
    h = t.hashes(start, end)
    inside = ~K.SPACE[t.data]
    out = {"n_words": np.diff(words), "word_chars": t.count(inside & ~_CONTINUATION[t.data]), "n_symbols": t.count(_SYMBOL[t.data])}
    # lines: ranges between newlines and text ends
    newline = np.flatnonzero(t.data == 10)
    text = np.searchsorted(t.at, newline, "right") - 1
    a = np.sort(np.concatenate([t.at[:-1], newline + 1]), kind="stable")
    owner = np.concatenate([np.arange(t.n), text])[np.argsort(np.concatenate([t.at[:-1] * 2, (newline + 1) * 2 - 1]), kind="stable")]
    b = np.append(a[1:] - 1, 0)
    last = np.append(owner[1:] != owner[:-1], True)
    b[last] = t.at[1:][owner[last]]
    used = np.searchsorted(start, b) > np.searchsorted(start, a)
    a, b, owner = a[used], b[used], owner[used]
    _, lines = K.distinct(t.hashes(a, b), owner, t.n)
    out["n_dup_lines"] = np.bincount(owner, minlength=t.n) - np.diff(lines)
    # words in windows that are found twice
    g, owner, place = K.windows(h, words, 3, short=False)
    order = np.lexsort((g, owner))
    same = (g[order][1:] == g[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h) + 1, np.int64)
    for k in range(3):
        covered[place[twice] + k] = 1
    sums = np.concatenate([[0], np.cumsum(covered[:-1])])
    out["n_repeat_words"] = np.diff(sums[words])
    return out


def _histograms(batches):
    """Counts by language and slot: class k is slot k, word bucket b slot CLASSES + b."""
    sums = K.Sums(CLASSES + BUCKETS, ("lang", "slot", "n"))
    for batch in batches:
        for i, j, data, at in K.chunks(batch.column("text")):
            langs = batch.column("lang").slice(i, j - i).to_pylist()
            classes = class_counts(K.Texts(data, at))
            buckets, words = word_buckets(data, at)
            text, kind = np.nonzero(classes)
            sums.add(langs, text, kind, classes[text, kind])
            sums.add(langs, K.owners(words), CLASSES + buckets)
            if sums.full:
                yield sums.told()
    yield sums.told()


def references(docs: DataFrame) -> dict:
    """Per language and for all (key None): shares of classes, common buckets, their shares and the share of all other words."""
    ship(docs.sparkSession)
    # one pass over the texts; at most 65,545 rows a language
    counts = saved(docs.select("lang", "text").mapInArrow(_histograms, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")), "histograms")
    langs = counts.where("lang is not null").select("lang").distinct().count()
    if langs > LANGUAGES:
        raise ValueError(f"{langs} languages, {LANGUAGES} at most: is lang the column of languages?")
    sums = counts.groupBy("slot").agg(F.sum("n").alias("all"))
    every = counts.where("lang is not null").join(F.broadcast(sums), "slot").select(F.lit(False).alias("whole"), "lang", "slot", "n", "all")  # at most 65,545 sums
    # texts without a language take part in the sum of all only
    every = every.union(sums.select(F.lit(True), F.lit(None).cast("string"), "slot", "all", "all"))
    w = Window.partitionBy("whole", "lang")  # at most 65,545 rows a language
    words = F.col("slot") >= CLASSES
    every = every.withColumns({
        "words": F.sum(F.when(words, F.col("n"))).over(w), "rank": F.row_number().over(w.orderBy(words.desc(), F.desc("n"), "slot"))})
    out: dict = {None: {"classes": np.zeros(CLASSES), "common": [], "words": 0}}
    for r in every.where(~words | (F.col("rank") <= COMMON)).collect():  # some sixty rows a language
        x = out.setdefault(r["lang"], {"classes": np.zeros(CLASSES), "common": [], "words": 0})
        x["words"] = r["words"] or 0
        if r["slot"] >= CLASSES:
            x["common"].append((r["slot"] - CLASSES, r["n"], r["all"]))
        else:
            x["classes"][r["slot"]] = r["n"]
    total = out[None]
    all_classes, all_words = total["classes"] / max(1, total["classes"].sum()), max(1, total["words"])
    for x in out.values():
        x["classes"] = x["classes"] + LENT_CHARS * all_classes
        x["classes"] /= max(1, x["classes"].sum())
        x["common"].sort()
        n = np.array([c for _, c, _ in x["common"]] + [x["words"] - sum(c for _, c, _ in x["common"])], float)
        lent = np.array([c for _, _, c in x["common"]], float) / all_words
        n += LENT_WORDS * np.append(lent, max(0.0, 1 - lent.sum()))
        x["buckets"], x["shares"] = np.array([b for b, _, _ in x["common"]], np.int64), n / max(1, n.sum())
    return out


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row to the reference; 0 for a row without counts."""
    total = counts.sum(1, keepdims=True)
    p, q = counts / np.maximum(total, 1), reference[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)).sum(1) / 2
    return np.where(total[:, 0] > 0, np.sqrt(np.clip(d, 0, 1)), 0.0)


def judged(refs: dict, batch: pa.RecordBatch):
    """(rows, columns) of each run of texts."""
    for i, j, data, at in K.chunks(batch.column("text")):
        t = K.Texts(data, at)
        out = base_counts(t)
        classes = class_counts(t)
        buckets, words = word_buckets(data, at)
        owner = K.owners(words)
        langs = batch.column("lang").slice(i, j - i).to_pylist()
        keys = [x if x in refs else None for x in langs]
        of = {key: [] for key in keys}
        for k, key in enumerate(keys):
            of[key].append(k)
        chars, common, nearest = np.zeros(j - i), np.zeros(j - i), np.full(j - i, np.inf)
        anyhow = of.pop(None, [])
        for key in refs if anyhow else of:
            own = np.sort(np.array([*of.get(key, []), *anyhow]))
            ref = refs[key]
            k = len(ref["buckets"])
            place = np.full(j - i, -1)
            place[own] = np.arange(len(own))
            mine = place[owner] >= 0
            seen = buckets[mine]
            slot = np.searchsorted(ref["buckets"], seen)
            slot[np.append(ref["buckets"], -1)[slot] != seen] = k
            counts = np.bincount(place[owner[mine]] * (k + 1) + slot, minlength=len(own) * (k + 1)).reshape(len(own), k + 1)
            c, d = distance(classes[own], ref["classes"]), distance(counts, ref["shares"])
            # the nearest reference is the one whose limits are kept best
            far = np.maximum(c / CHAR_LIMIT, d / WORD_LIMIT)
            near = far < nearest[own]
            at = own[near]
            chars[at], common[at], nearest[at] = c[near], d[near], far[near]
        out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
        out["char_distance"], out["word_distance"] = chars, common
        out["kept"] = ~out["base_failed"] & ((out["word_chars"] < LEAST_CHARS) | (chars <= CHAR_LIMIT)) & ((out["n_words"] < LEAST_WORDS) | (common <= WORD_LIMIT))
        yield i, j, out


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id with the counts, distances and verdict of every row."""
    refs = references(docs)
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches):
        for batch in batches:
            for i, j, out in judged(refs, batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *[pa.array(out[c]) for c in names]], ["doc_id", *names])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {FIELDS}")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    refs = references(docs)

    def run(batches):
        for batch in batches:
            for i, j, out in judged(refs, batch):
                yield batch.slice(i, j - i).filter(pa.array(out["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op9(docs: DataFrame) -> DataFrame:
    return quality_rules(docs)
