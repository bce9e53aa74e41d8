"""Heuristic and model-assisted ranking of search results, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How well a format suits a reader.
FORMATS = {"epub": 1.0, "azw3": 0.95, "kepub": 0.95, "mobi": 0.85, "azw": 0.85, "fb2": 0.75, "txt": 0.5, "rtf": 0.5, "docx": 0.4, "doc": 0.4, "lit": 0.4, "pdf": 0.35, "djvu": 0.15}
OTHER_FORMAT = 0.2
#: Parts of titles that hint at study aids.
SUSPICIOUS = ("summary", "study guide", "sparknotes", "cliffsnotes", "sample", "excerpt")
REFLOWED = ("epub", "azw3", "mobi", "azw", "fb2")
LEAST_BM25 = 1.1754943508222875e-38
TOP_WORKS, GENUINE_MID, RELEVANCE_SCALE = 8, 6.5, 4.0


def format_score(extension: Column) -> Column:
    out = F.lit(OTHER_FORMAT)
    for k, v in FORMATS.items():
        out = F.when(extension == k, v).otherwise(out)
    return out


def size_score(extension: Column, filesize: Column) -> Column:
    mb, flows = filesize / 1_048_576, extension.isin(*REFLOWED)
    return F.when(filesize == 0, 0.6).when(flows & (mb < 0.05), 0.2).when(flows & (mb > 60), 0.6).when((extension == "pdf") & (mb > 80), 0.5).otherwise(1.0)


def ereader_fit(extension: Column, filesize: Column) -> Column:
    return format_score(extension) * 0.8 + size_score(extension, filesize) * 0.2


def completeness(*columns: Column) -> Column:
    return sum((F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0) for c in columns), F.lit(0)) / len(columns)


def suspicious(title: Column) -> Column:
    return F.lower(title).rlike("|".join(SUSPICIOUS))


def genuine(title: Column, *metadata: Column) -> Column:
    return F.when(suspicious(title), 0.2).otherwise(0.8 + 0.2 * completeness(*metadata))


def combine(bm25n: Column, relevance: Column, ereader: Column, genuine_: Column, by_model: Column) -> Column:
    base = F.when(by_model, 0.3 * bm25n + 0.35 * relevance + 0.35 * ereader).otherwise(0.65 * bm25n + 0.35 * ereader)
    return base * (0.6 + 0.4 * genuine_)


def heuristic(results: DataFrame) -> DataFrame:
    """Adds bm25n, ereader, genuine and score to (query_id, bm25, title, author, year, language, publisher, extension, filesize)."""
    most = F.greatest(F.max("bm25").over(Window.partitionBy("query_id")), F.lit(LEAST_BM25))
    rows = results.withColumns({
        "bm25n": F.col("bm25") / most, "ereader": ereader_fit(F.col("extension"), F.col("filesize")),
        "genuine": genuine(F.col("title"), *map(F.col, ("author", "year", "language", "publisher")))})
    return rows.withColumn("score", combine(F.col("bm25n"), F.col("bm25n"), F.col("ereader"), F.col("genuine"), F.lit(False)))


def rerank(results: DataFrame, window: int = 24, limit: int = 40, answers: DataFrame | None = None, answer_keys: tuple[str, ...] = ("query_id", "doc_id")) -> DataFrame:
    """The head of each query's results by score, then the tail in the order of bm25, cut to ``limit``.

    answers: (keys, relevance, genuine) of a model; rows without one keep the heuristic."""
    by_bm25 = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "doc_id")
    rows = heuristic(results).withColumn("bm25_position", F.row_number().over(by_bm25))
    if answers is not None:
        told = answers.select(*answer_keys, F.col("relevance").alias("_rel"), F.col("genuine").alias("_gen"))
        rows = rows.join(told, list(answer_keys), "left").withColumn("score", F.when(
            F.col("_rel").isNotNull(), combine(F.col("bm25n"), F.col("_rel"), F.col("ereader"), F.col("_gen"), F.lit(True))).otherwise(F.col("score"))).drop("_rel", "_gen")
    tail = F.col("bm25_position") > window
    order = Window.partitionBy("query_id").orderBy(tail, F.when(~tail, -F.col("score")), "bm25_position")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def work_key(title: Column, author: Column) -> Column:
    return F.concat(F.lower(F.trim(title)), F.lit("␟"), F.lower(F.trim(author)))


def first_works(results: DataFrame, most: int = TOP_WORKS) -> DataFrame:
    """The first works of each query in rank order: query_id, work, first position, files."""
    works = results.groupBy("query_id", work_key(F.col("title"), F.col("author")).alias("work")).agg(F.min("position").alias("first"), F.count("*").alias("files"))
    return works.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "work"))).where(F.col("place") <= most)


def expected_level(probabilities: Column, score: Column, levels: int) -> Column:
    """A model's answer as 0 to 1: the mean level of its probabilities, else its score, mended if it counts from one."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, p: a + p)
    mean = F.aggregate(F.transform(probabilities, lambda p, i: p * i), F.lit(0.0), lambda a, p: a + p) / total / (levels - 1)
    mended = F.when(score > levels - 1, score - 1).otherwise(score) / (levels - 1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(total > 0, mean).otherwise(mended)))


def log_sum_exp(values: Column) -> Column:
    most = F.array_max(values)
    return most + F.log(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - most)))


def calibrate(answers: DataFrame) -> DataFrame:
    """(query_id, relevant, aid: log-odds) to relevance and genuine."""
    best = F.max("relevant").over(Window.partitionBy("query_id"))
    return answers.withColumns({"relevance": F.exp((F.col("relevant") - best) / RELEVANCE_SCALE), "genuine": 1 - 1 / (1 + F.exp(-(F.col("aid") - GENUINE_MID)))})


def with_scorer(results: DataFrame, scorer, schema: str) -> DataFrame:
    """Extension point: a function of pandas batches that adds a model's answers, off unless it is given."""
    return results.mapInPandas(scorer, schema) if scorer else results
