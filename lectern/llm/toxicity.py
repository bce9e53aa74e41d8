"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are words and beginnings of words (4 to 6 bytes) that occur. Those
whose document frequencies in a labelled sample differ between toxic and clean
texts, in either direction, beyond chance are kept; the regression
P(grade >= k) = sigmoid(w x - threshold_k) shares its weights among the ordered
thresholds. The output is the expected severity, and a document is toxic from
0.5 on.

Labels may hold up to ``GRADES`` ordered grades beside 0 for clean; only their
order counts, and more are an error. Where they only tell
toxic from clean, toxic texts of the sample are graded 1 or 2 by how much of
them is toxic: the number of sentences that word statistics of the other texts
(the sample is dealt into folds, a text's own fold is left out) call toxic.

The sample is at most ``SAMPLE`` labelled documents of each kind, taken by a hash
of the id; scoring reads every whole text.

Defined results: null and empty texts have no features; without toxic labels
nothing is toxic; a document with several labels counts by the highest, labels
that are null or below 0 don't count; equal rows get equal scores; features with
equal evidence rank by hash; an empty table gives no rows; other columns are kept
by the filter and ignored by the scores; a text is handled whole, however long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import saved, ship

#: Bounds of the fit: labelled documents of each kind, features, and grades above clean.
SAMPLE, FEATURES, GRADES = 5_000, 4_096, 32
PREFIXES = (4, 5, 6)
LIMIT = 0.5
ROUNDS, RATE, SHRINK = 600, 0.2, 2e-5
#: Documents that hold a feature, and its likelihood ratio (twice the logarithm, as of a chi-square value), at least.
LEAST_DOCS, LEAST_RATIO = 4, 12.0
#: Folds for grading, log-odds of words that make a sentence toxic, and the toxic sentences from which a text is severe.
FOLDS, TELLING_ODDS, SEVERE = 5, 3.0, 3
_BITS = 22


def _all_features(t: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place of its word, offsets of the texts' words) of every word and its beginnings."""
    start, end, words = t.words(K.NO_LETTER)
    hashes, place = [t.hashes(start, end)], [np.arange(len(start))]
    for k in PREFIXES:
        longer = np.flatnonzero(end - start > k)
        hashes.append(t.hashes(start[longer], start[longer] + k) ^ K.U(k))
        place.append(longer)
    return np.concatenate(hashes), np.concatenate(place), words


def _sample_features(batches):
    for batch in batches:
        for i, j, data, at in K.chunks(batch.column("text")):
            h, place, words = _all_features(K.Texts(data, at, lower=True))
            h, offsets = K.distinct(h, K.owners(words)[place], j - i)
            yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(i, j - i), K.lists(h, offsets)], ["toxic", "features"])


class Model:
    """Weights of features (sorted hashes) and thresholds of the grades."""

    def __init__(self, features: np.ndarray, grades: int = 2):
        self.features = np.sort(features)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.features >> K.U(64 - _BITS)] = True
        self.weights, self.thresholds = np.zeros(len(features)), 3.0 * np.arange(1, grades + 1)

    def hits(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, text) of the features that occur, and each text's words that speak for toxicity."""
        n, m = len(at) - 1, max(1, len(self.features))
        h, place, words = _all_features(K.Texts(data, at, lower=True))
        some = np.flatnonzero(self.maybe[h >> K.U(64 - _BITS)])
        h, place = h[some], place[some]
        index = np.minimum(np.searchsorted(self.features, h), m - 1)
        found = self.features[index] == h if len(self.features) else np.zeros(len(h), bool)
        index, place = index[found], place[found]
        owner = np.searchsorted(words, place, "right") - 1
        pair = np.unique(owner * m + index)
        telling = np.unique(place[self.weights[index] > 0]) if len(self.features) else place
        return pair % m, pair // m, np.bincount(np.searchsorted(words, telling, "right") - 1, minlength=n)

    def reach(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))

    def severity(self, feature: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        return self.reach(np.bincount(text, self.weights[feature], minlength=n)).sum(1)

    def parameters(self) -> np.ndarray:
        """Weights, the first threshold and the logarithms of the gaps between thresholds."""
        return np.concatenate([self.weights, self.thresholds[:1], np.log(np.diff(self.thresholds))])

    def assume(self, p: np.ndarray) -> None:
        m = len(self.weights)
        self.weights, self.thresholds = p[:m], p[m] + np.concatenate([[0.0], np.cumsum(np.exp(p[m + 1 :]))])

    def objective(self, feature: np.ndarray, text: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean log-likelihood of the grades less the penalty on weights, and its gradient in the parameters."""
        n, m, levels = len(grade), len(self.weights), len(self.thresholds)
        reach = self.reach(np.bincount(text, self.weights[feature], minlength=n))
        above = np.concatenate([np.ones((n, 1)), reach, np.zeros((n, 1))], 1)
        rows = np.arange(n)
        mass = np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-12)
        slope = above * (1 - above)
        high, low = slope[rows, grade] / mass, slope[rows, grade + 1] / mass
        by_score = high - low
        by_threshold = np.array([(np.where(grade == k, -high, 0) + np.where(grade + 1 == k, low, 0)).sum() / n for k in range(1, levels + 1)])
        # a gap moves all thresholds above it
        by_gap = np.cumsum(by_threshold[::-1])[::-1][1:] * np.diff(self.thresholds)
        gradient = np.concatenate([np.bincount(feature, by_score[text], minlength=m) / n - SHRINK * self.weights, [by_threshold.sum()], by_gap])
        return float(np.log(mass).mean() - SHRINK * (self.weights**2).sum() / 2), gradient

    def fit(self, feature: np.ndarray, text: np.ndarray, grade: np.ndarray) -> None:
        """Gradient steps (Adam) on the objective."""
        p = self.parameters()
        first, second = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, ROUNDS + 1):
            self.assume(p)
            _, g = self.objective(feature, text, grade)
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            p = p + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        self.assume(p)


def log_odds(toxic: Column, clean: Column, all_toxic: Column, all_clean: Column) -> Column:
    """Log-odds of a toxic text that holds something, less those of a clean one."""
    return F.log((toxic + 0.5) / (all_toxic - toxic + 0.5)) - F.log((clean + 0.5) / (all_clean - clean + 0.5))


def likelihood_ratio(toxic: Column, clean: Column, all_toxic: Column, all_clean: Column) -> Column:
    """How much better two rates, of toxic and of clean texts, explain who holds something than a common one does."""
    both, every = toxic + clean, all_toxic + all_clean

    def part(seen: Column, held: Column, of: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * every / (held * of))).otherwise(0.0)

    return 2 * (part(toxic, both, all_toxic) + part(clean, both, all_clean) + part(all_toxic - toxic, every - both, all_toxic) + part(all_clean - clean, every - both, all_clean))


def graded(texts: DataFrame) -> DataFrame:
    """(key, toxic, text) of the sample to (key, grade) of its toxic texts."""
    fold = F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(FOLDS))
    rows = texts.select("key", (F.col("toxic") > 0).cast("long").alias("toxic"), fold.alias("fold"), F.posexplode(F.split("text", r"[.!?\n]+")).alias("at", "sentence"))
    words = rows.select("key", "toxic", "fold", "at", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("sentence"), F.lit(r"\p{L}+"), 0))).alias("word"))
    own = words.select("key", "toxic", "fold", "word").distinct().groupBy("word", "fold").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    every = own.groupBy("word").agg(F.sum("t").alias("all_t"), F.sum("n").alias("all_n"))
    sizes = texts.select((F.col("toxic") > 0).cast("long").alias("toxic"), fold.alias("fold")).groupBy("fold").agg(F.sum("toxic").alias("fold_t"), F.count("*").alias("fold_n"))
    total = sizes.agg(F.sum("fold_t").alias("sum_t"), F.sum("fold_n").alias("sum_n"))
    sizes = F.broadcast(sizes.join(F.broadcast(total)).select("fold", (F.col("sum_t") - F.col("fold_t")).alias("rest_t"), (F.col("sum_n") - F.col("sum_t") - F.col("fold_n") + F.col("fold_t")).alias("rest_c")))  # a row per fold, and one
    t, n = F.col("all_t") - F.col("t"), F.col("all_n") - F.col("n")
    of = t, n - t, F.col("rest_t"), F.col("rest_c")
    telling = own.join(every, "word").join(sizes, "fold").where((log_odds(*of) >= TELLING_ODDS) & (likelihood_ratio(*of) >= LEAST_RATIO)).select("word", "fold", F.lit(1.0).alias("telling"))
    by_sentence = words.where("toxic = 1").join(telling, ["word", "fold"], "left").groupBy("key", "at").agg(F.max(F.coalesce("telling", F.lit(0.0))).alias("is"))
    return by_sentence.groupBy("key").agg((1 + (F.sum("is") >= SEVERE).cast("long")).alias("grade"))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the model on a bounded sample of the labelled documents."""
    ship(docs.sparkSession)
    marks = labels.where("toxic >= 0").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    sizes = dict(marks.groupBy("toxic").count().limit(GRADES + 2).collect())  # a row per grade
    grades = sorted(g for g in sizes if g > 0)
    if len(grades) > GRADES:
        raise ValueError(f"more than {GRADES} grades of toxicity")
    if grades != [*range(1, len(grades) + 1)]:
        # the place in their order stands for each grade
        rank = {0: 0} | {g: k for k, g in enumerate(grades, 1)}
        marks = marks.withColumn("toxic", sum((F.when(F.col("toxic") == g, k).otherwise(0) for g, k in rank.items()), F.lit(0)).cast("long"))
        sizes = {rank[g]: n for g, n in sizes.items()}
    share = F.lit(0.0)
    for kind, n in sizes.items():
        share = F.when(F.col("toxic") == kind, SAMPLE / n).otherwise(share)
    marks = marks.where(F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1_000_000)) / 1_000_000 < share)
    texts = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")  # some SAMPLE ids a grade
    texts = saved(texts.select(F.xxhash64("doc_id", "text").alias("key"), "toxic", "text"), "labelled")
    if max(sizes, default=0) == 1:
        texts = saved(texts.join(graded(texts), "key", "left").select(F.when(F.col("toxic") > 0, F.coalesce("grade", F.lit(1))).otherwise(0).cast("long").alias("toxic"), "text"), "graded")
    seen = dict(texts.groupBy((F.col("toxic") > 0).alias("is")).count().collect())
    counted = texts.mapInArrow(_sample_features, "toxic long, features array<long>").select((F.col("toxic") > 0).cast("long").alias("toxic"), F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    ratio = likelihood_ratio(F.col("t"), F.col("n") - F.col("t"), F.lit(seen.get(True, 0)), F.lit(seen.get(False, 0)))
    told = counted.where((F.col("n") >= LEAST_DOCS) & (ratio >= LEAST_RATIO)).orderBy(F.desc(ratio), "f").limit(FEATURES).select("f").collect()
    model = Model(np.array([r[0] for r in told], np.int64).view(K.U), max([1, *sizes]) if max(sizes, default=0) != 1 else 2)
    if not len(told) or not seen.get(True):
        return Model(np.zeros(0, K.U))

    def hits(batches):
        for batch in batches:
            for i, j, data, at in K.chunks(batch.column("text")):
                feature, text, _ = model.hits(data, at)
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(i, j - i), K.lists(feature.astype(K.U), np.searchsorted(text, np.arange(j - i + 1)))], ["toxic", "features"])

    rows = texts.mapInArrow(hits, "toxic long, features array<long>").collect()  # the sample's features
    model.fit(np.array([f for r in rows for f in r["features"]], np.int64), np.repeat(np.arange(len(rows)), [len(r["features"]) for r in rows]), np.array([r["toxic"] for r in rows], np.int64))
    return model


def _severities(model: Model, batch: pa.RecordBatch):
    for i, j, data, at in K.chunks(batch.column("text")):
        feature, text, words = model.hits(data, at)
        yield i, j, model.severity(feature, text, j - i), words


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_severity, telling_words, toxic and kept of every row."""
    model = trained(docs, labels)

    def run(batches):
        for batch in batches:
            for i, j, severity, words in _severities(model, batch):
                toxic = severity >= LIMIT
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *map(pa.array, (severity, words, toxic, ~toxic))], ["doc_id", "expected_severity", "telling_words", "toxic", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, expected_severity double, telling_words long, toxic boolean, kept boolean")


def toxicity_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns."""
    model = trained(docs, labels)

    def run(batches):
        for batch in batches:
            for i, j, severity, _ in _severities(model, batch):
                yield batch.slice(i, j - i).filter(pa.array(severity < LIMIT))

    return docs.mapInArrow(run, docs.schema)


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity(docs, labels)
