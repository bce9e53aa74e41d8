"""Language identification by Bayesian evidence fusion.

Evidence on each text: the likelihood of its byte trigrams under each language
(trained on all documents whose language is given), the language that the
markup declares, the address's suffix (a path segment of two letters, else the
top level domain, whatever it is: what it says of languages is learned), and a
prior of its host. Host priors are smoothed in a hierarchy
- host, registered domain, everything - from grouped sums of the text-only
posteriors; so are the reliabilities of declarations and addresses. All of it is
added up as logarithms.

Documents have no markup or address: their source stands for the host. Pages'
text is what remains of the html without scripts, styles and tags.

Defined results: null or empty text has flat likelihoods, so the other evidence
decides; a null host counts with all null hosts; ties go to the first language
in order; without training texts no row gets a language; more languages than
``MOST_LANGUAGES`` are an error; equal rows get equal
results; ids that are no numbers read as null; empty tables give no rows; other
columns are ignored; a text is handled whole, however long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import saved, ship

BUCKETS = 16_384
#: Languages and (language, bucket) counts that the driver and each task hold, 12 bytes a count; more are an error.
MOST_LANGUAGES, MOST_COUNTS = 10_000, 20_000_000
#: Up to so many languages, tasks keep log-probabilities as a table; with more, they look up the languages that have a bucket, so many entries at once.
WHOLE_TABLE, BLOCK = 64, 2_000_000
#: Cells of a matrix of rows and languages.
MATRIX = 1_000_000
#: A text's posterior below this isn't added to sums: 10^12 rows of it would come to less than what a level lends.
LEAST = 1e-30
#: Trigrams overlap, so a text's log-likelihood counts by this share. It is a mean over the text from so many trigrams on:
#: a longer text says no more about its language, and what its markup and host say must not drown in it.
TEMPER, ENOUGH = 0.3, 2_000
#: Pseudo-counts: that a level of the hierarchy lends the one below, and of declarations and addresses that are right.
LENT, AGREE = 5.0, 5.0
#: (key, language) sums that are broadcast, 12 bytes each; more are joined by shuffle.
BROADCAST_CELLS = 3_000_000
COUNTRY = {"uk": "en", "us": "en", "au": "en", "at": "de", "ch": "de", "mx": "es", "ar": "es"}


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all byte trigrams inside a text."""
    low = K.LOWER[data].astype(np.int64)
    text = K.owners(at)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = ((low[:-2] * 65_536 + low[1:-1] * 256 + low[2:]) * 0x9E3779B1 >> 11) % BUCKETS
    same = text[:-2] == text[2:]
    return code[same], text[:-2][same]


def _trained(batches):
    sums = K.Sums(BUCKETS, ("lang", "bucket", "n"))
    for batch in batches:
        for i, j, data, at in K.chunks(batch.column("text")):
            code, text = trigrams(data, at)
            sums.add(batch.column("lang").slice(i, j - i).to_pylist(), text, code)
            if sums.full:
                yield sums.told()
    yield sums.told()


class TextModel:
    """Bucket counts of every language, sparse: for each bucket, the languages that have it."""

    def __init__(self, langs: list[str], lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        self.langs, self.number = langs, {x: k for k, x in enumerate(langs)}
        order = np.lexsort((lang, bucket))
        self.lang, self.at = lang[order].astype(np.int32), np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        total = np.bincount(lang, n, len(langs)) + 0.5 * BUCKETS
        # log-probability of a bucket that the language lacks, and what it gains in one that the language has
        self.least, self.gain = np.log(0.5 / total), np.log((n[order] + 0.5) / 0.5)
        self._table: np.ndarray | None = None

    def likelihoods(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tempered log-likelihood of each text, a column per language."""
        code, text = trigrams(data, at)
        texts, n = len(at) - 1, np.bincount(text, minlength=len(at) - 1)
        sums = n[:, None] * self.least
        if len(self.langs) <= WHOLE_TABLE:
            if self._table is None:
                self._table = np.zeros((len(self.langs), BUCKETS))
                self._table[self.lang, np.repeat(np.arange(BUCKETS), np.diff(self.at))] = self.gain
            for k, row in enumerate(self._table):
                sums[:, k] += np.bincount(text, row[code], texts)
        else:
            pair, often = np.unique(text * BUCKETS + code, return_counts=True)
            size = np.diff(self.at)[pair % BUCKETS]
            cut = np.unique(np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), BLOCK), "right"))
            for i, j in zip(cut, [*cut[1:], len(pair)], strict=False):
                owner, from_ = np.repeat(np.arange(i, j), size[i:j]), self.at[pair[i:j] % BUCKETS]
                entry = np.arange(len(owner)) + np.repeat(from_ - np.cumsum(size[i:j]) + size[i:j], size[i:j])
                first = pair[i] // BUCKETS
                held = pair[j - 1] // BUCKETS - first + 1
                cell = (pair[owner] // BUCKETS - first) * len(self.langs) + self.lang[entry]
                sums[first : first + held] += np.bincount(cell, often[owner] * self.gain[entry], held * len(self.langs)).reshape(held, len(self.langs))
        return sums * (TEMPER * np.minimum(1, ENOUGH / np.maximum(n, 1)))[:, None]


def text_model(docs: DataFrame) -> TextModel:
    """Counts over all documents with a language. More languages or counts than the driver is to hold are an error."""
    ship(docs.sparkSession)
    counts = saved(docs.where("lang is not null").select("lang", "text").mapInArrow(_trained, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    size = counts.agg(F.count("*"), F.count_distinct("lang")).first()
    spoken = docs.where("lang is not null").select("lang").distinct().limit(MOST_LANGUAGES + 1).toArrow().column(0).to_pylist()
    if len(spoken) > MOST_LANGUAGES or size[0] > MOST_COUNTS:
        raise ValueError(f"{len(spoken)} languages with {size[0]} trigram counts; at most {MOST_LANGUAGES} and {MOST_COUNTS} are told apart")
    langs = sorted(spoken) if size[1] else []
    number, found = {x: k for k, x in enumerate(langs)}, counts.toArrow()
    names = found.column("lang").combine_chunks().dictionary_encode()
    lang = np.array([number[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()] if found.num_rows else np.zeros(0, np.int64)
    return TextModel(langs, lang, found.column("bucket").to_numpy(), found.column("n").to_numpy())


def visible(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " "), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def page_evidence(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    top = F.substring_index(host, ".", -1)
    for k, v in COUNTRY.items():
        top = F.when(top == k, v).otherwise(top)
    return pages.select(
        F.lit("pages").alias("table"), F.col("page_id").try_cast("long").alias("id"), host.alias("host"), F.substring_index(host, ".", -2).alias("domain"),
        F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2})", 1)).alias("declared"), F.when(path != "", path).otherwise(top).alias("suffix"), visible(F.col("html")).alias("text"))


def document_evidence(docs: DataFrame) -> DataFrame:
    none = F.lit("")
    return docs.select(F.lit("documents").alias("table"), F.col("doc_id").try_cast("long").alias("id"), F.col("source").alias("host"), none.alias("domain"), none.alias("declared"), none.alias("suffix"), "text")


def _softmax(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _runs(n: int, langs: int):
    """(first, end) of runs of rows of which a matrix with all languages is of bounded size."""
    step = max(1, MATRIX // max(1, langs))
    return ((i, min(n, i + step)) for i in range(0, n, step))


def _scored(model: TextModel):
    """Replaces the text by its log-likelihoods, and a declaration that is no known language by none."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names[:-1]
            for a, b, data, at in K.chunks(batch.column("text")):
                for i, j in _runs(b - a, len(model.langs)):
                    ll = model.likelihoods(data[at[i] : at[j]], at[i : j + 1] - at[i])
                    given = {c: batch.column(c).slice(a + i, j - i) for c in names}
                    given["declared"] = pa.array([x if x in model.number else "" for x in given["declared"].to_pylist()], pa.string())
                    for c in ("host", "domain", "suffix"):
                        given[c] = pc.fill_null(given[c], "")
                    yield pa.RecordBatch.from_arrays([*given.values(), pa.ListArray.from_arrays(np.arange(j - i + 1, dtype=np.int32) * ll.shape[1], pa.array(ll.ravel()))], [*names, "ll"])

    return run


#: What posteriors are summed up by.
LEVELS = (("host", ("table", "domain", "host")), ("declared", ("table", "declared")), ("suffix", ("table", "suffix")))


def _summed(n: int):
    """(level, table, a, b, lang, s): sums of text-only posteriors by key and language, and, as language -1, numbers of rows."""

    def run(batches):
        for batch in batches:
            ll = batch.column("ll").flatten().to_numpy().reshape(-1, n)
            for i, j in _runs(batch.num_rows, n):
                p = _softmax(ll[i:j])
                p[p < LEAST] = 0
                for level, columns in LEVELS:
                    code, names = np.zeros(j - i, np.int64), []
                    for c in columns:
                        d = batch.column(c).slice(i, j - i).dictionary_encode()
                        code = code * len(d.dictionary) + d.indices.to_numpy()
                        names.append(batch.column(c).slice(i, j - i))
                    _, first, key = np.unique(code, return_index=True, return_inverse=True)
                    order = np.argsort(key, kind="stable")
                    sums = np.add.reduceat(p[order], np.searchsorted(key[order], np.arange(len(first))), axis=0)
                    k, lang = np.nonzero(sums)
                    at = pa.array(first[np.concatenate([np.arange(len(first)), k])])
                    keys = [x.take(at) for x in names] + [pa.array([""] * len(at))] * (3 - len(names))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([level] * len(at)), *keys, pa.array(np.concatenate([np.full(len(first), -1), lang]).astype(np.int32)), pa.array(np.concatenate([np.bincount(key).astype(float), sums[k, lang]]))],
                        ["level", "table", "a", "b", "lang", "s"])

    return run


def _dense(langs: pa.Array, sums: pa.Array, n: int) -> np.ndarray:
    """A row of n sums for each list of languages and their sums."""
    out = np.zeros((len(langs), n))
    out[K.owners(np.asarray(langs.offsets)), langs.flatten().to_numpy()] = sums.flatten().to_numpy()
    return out


def _fused(langs: list[str], tables: dict[str, tuple[np.ndarray, float]]):
    """Adds up the logarithms of all evidence. tables: sums of text-only posteriors and number of rows of each table."""
    n, names = len(langs), np.array(langs, object)
    number = {x: k for k, x in enumerate(langs)}
    totals = np.stack([s for s, _ in tables.values()])
    counts = np.array([c for _, c in tables.values()])
    place = {t: k for k, t in enumerate(tables)}

    def smoothed(own: np.ndarray, above: np.ndarray) -> np.ndarray:
        return (own + LENT * above) / (own.sum(1, keepdims=True) + LENT)

    every = smoothed(totals, np.full_like(totals, 1 / n))

    def own_name(column: pa.Array) -> np.ndarray:
        """AGREE where the column names the language."""
        out = np.zeros((len(column), n))
        hit = [(i, number[x]) for i, x in enumerate(column.to_pylist()) if x in number]
        if hit:
            out[tuple(np.array(hit).T)] = AGREE
        return out

    def run(batches):
        for batch in batches:
            for i, j in _runs(batch.num_rows, n):
                part = {c: batch.column(c).slice(i, j - i) for c in batch.schema.names}
                part = {c: pa.concat_arrays([x]) if pa.types.is_list(x.type) else x for c, x in part.items()}
                sums = {c: _dense(part[f"{c}_lang"], part[f"{c}_s"], n) for c in ("domain", "host", "declared", "suffix")}
                ll = part["ll"].flatten().to_numpy().reshape(-1, n)
                t = np.array([place[x] for x in part["table"].to_pylist()], np.int64)
                logs = ll + np.log(smoothed(sums["host"], smoothed(sums["domain"], every[t])))
                # a declaration is a language that occurs, or none; any suffix that is unseen with a language counts by its share of all rows
                logs += np.log(sums["declared"] + 0.5 + own_name(part["declared"])) - np.log(totals[t] + AGREE + 0.5 * (n + 1))
                logs += np.log(sums["suffix"] + own_name(part["suffix"]) + (part["suffix_rows"].to_numpy() / counts[t])[:, None]) - np.log(totals[t] + AGREE + 1)
                p = _softmax(logs)
                told = ll.max(1) > ll.min(1)
                yield pa.RecordBatch.from_arrays(
                    [part["table"], part["id"], pa.array(names[p.argmax(1)], pa.string()), pa.array(p.max(1)), pa.array(np.where(told, names[ll.argmax(1)], None), pa.string())],
                    ["table", "id", "lang", "confidence", "text_lang"])

    return run


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """(table, id, host, domain, declared, suffix, text) to table, id, lang, confidence and text_lang."""
    langs, n = model.langs, len(model.langs)
    ship(rows.sparkSession)
    kept = ["table", "id", "host", "domain", "declared", "suffix"]
    schema = ", ".join(f"{c} {'long' if c == 'id' else 'string'}" for c in kept)
    scored = saved(rows.select(*kept, "text").mapInArrow(_scored(model), f"{schema}, ll array<double>"), "likelihoods")
    # sums by key and language, sparse; a key's languages are put together once they are summed up
    cells = scored.mapInArrow(_summed(n), "level string, table string, a string, b string, lang int, s double")
    cells = saved(cells.groupBy("level", "table", "a", "b", "lang").agg(F.sum("s").alias("s")), "sums")

    def listed(cells: DataFrame, name: str, *keys: str) -> DataFrame:
        of = F.sort_array(F.collect_list(F.when(F.col("lang") >= 0, F.struct("lang", "s"))))
        return cells.groupBy(*keys).agg(of["lang"].alias(f"{name}_lang"), of["s"].alias(f"{name}_s"), F.max(F.when(F.col("lang") < 0, F.col("s"))).alias(f"{name}_rows"), F.count("*").alias("_held"))

    hosts = cells.where("level = 'host'").withColumnsRenamed({"a": "domain", "b": "host"})
    domains = hosts.groupBy("table", "domain", "lang").agg(F.sum("s").alias("s"))
    tables: dict[str, tuple[np.ndarray, float]] = {}
    for t, k, s in domains.groupBy("table", "lang").agg(F.sum("s")).collect():  # two tables, at most all languages
        sums, _ = tables.setdefault(t, (np.zeros(n), 0.0))
        if k < 0:
            tables[t] = (sums, s)
        else:
            sums[k] = s
    fused = scored
    for name, keys, of in (("host", ["table", "domain", "host"], hosts), ("domain", ["table", "domain"], domains), *((c, ["table", c], cells.where(f"level = '{c}'").withColumnRenamed("a", c)) for c in ("declared", "suffix"))):
        told = saved(listed(of, name, *keys), name)
        small = (told.agg(F.sum("_held"), F.count("*")).first()[0] or 0) <= BROADCAST_CELLS
        fused = fused.join(F.broadcast(told.drop("_held")) if small else told.drop("_held"), keys)
    return fused.mapInArrow(_fused(langs, tables), "table string, id long, lang string, confidence double, text_lang string")


def identified(docs: DataFrame, pages: DataFrame) -> DataFrame:
    model = text_model(docs)
    rows = document_evidence(docs).unionByName(page_evidence(pages))
    if not model.langs:
        return rows.select("table", "id", *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("confidence", "double"), ("text_lang", "string"))])
    return identify(rows, model)


def op7(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """All documents (doc_id) and all pages (page_id) with their language."""
    found = identified(docs, pages)
    return found.select(
        "table", F.when(F.col("table") == "documents", F.col("id")).alias("doc_id"), F.when(F.col("table") == "pages", F.col("id")).alias("page_id"),
        "lang", F.round("confidence", 6).alias("confidence"), "text_lang")
