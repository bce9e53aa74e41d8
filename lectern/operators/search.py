"""Ranked full-text search of many queries in one job.

A query's terms meet the documents' tokens in an equi-join on the term; scores
are grouped sums. The attempts of the cascade - all terms, all terms with one
typo each, any term - are computed in the same plan, and each query keeps the
first attempt that has results after its filters. Texts are dealt by document once
and analysed once; what is summed up by document stays in its task, of which only
the best documents of each query leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import analyze
from lectern.scratch import saved, scratch_path

K1, B = 1.2, 0.75
BOOSTS = {"title": 3.0, "author": 2.0, "series": 1.2, "publisher": 0.5, "isbn": 1.0}
LIMIT, MOST = 40, 100
#: What a term with a typo scores in place of its own weight.
FUZZY_SCORE = 1.0
#: Rows that are broadcast at most, and bytes of text, about, that a task gets.
BROADCAST_ROWS, TASK_BYTES = 200_000, 8 << 20


def clamp(limit: int | None) -> int:
    return min(max(LIMIT if limit is None else limit, 1), MOST)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, query) to one row per distinct term, with n_terms."""
    terms = queries.select("query_id", F.array_distinct(analyze(F.col("query"))).alias("terms"))
    return terms.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def postings(docs: DataFrame, fields: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document, field and token: doc_id, field, len (tokens of the field), token."""
    each = F.array(*[F.struct(F.lit(name).alias("field"), analyze(c).alias("tokens")) for name, c in fields.items()])
    rows = docs.select("doc_id", *keep, F.explode(each).alias("f"))
    return rows.select("doc_id", *keep, "f.field", F.size("f.tokens").alias("len"), F.explode("f.tokens").alias("token"))


def tasks(docs: DataFrame, texts: list[Column], size: int = TASK_BYTES) -> int:
    """Into how many tasks texts are dealt, so that each gets a bounded part however many there are."""
    total = docs.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0).cast("long")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // size))


def frequencies(docs: DataFrame, fields: dict[str, Column], wanted: DataFrame | None = None, where: Column | None = None) -> tuple[DataFrame, DataFrame, int]:
    """doc_id, field, token, tf, len, allowed (``where``) of the tokens in ``wanted`` (token) or of all; field, n, mean_len: documents and mean length; tasks.

    Texts are dealt by document, analysed and counted once; both are read from what that leaves. An empty token stands for the field itself."""
    spark, n, path = docs.sparkSession, tasks(docs, list(fields.values())), scratch_path(docs.sparkSession, "frequencies")
    allowed = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    dealt = docs.select("doc_id", allowed.alias("allowed"), *[c.alias(f"_{name}") for name, c in fields.items()]).repartition(n, "doc_id")
    each = F.array(*[F.struct(F.lit(name).alias("field"), analyze(F.col(f"_{name}")).alias("tokens")) for name in fields])
    rows = dealt.select("doc_id", "allowed", F.explode(each).alias("f"))
    rows = rows.select("doc_id", "allowed", "f.field", F.size("f.tokens").alias("len"), F.explode(F.array_append("f.tokens", F.lit(""))).alias("token"))
    if wanted is not None:
        rows = rows.join(small(wanted.select("token").union(spark.createDataFrame([("",)], "token string")).distinct()), "token", "left_semi")
    counted = rows.groupBy("doc_id", "field", "token", "len", "allowed").agg(F.count("*").alias("tf"))
    counted.write.parquet(path)
    held = spark.read.schema(counted.schema).parquet(path)
    sizes = held.where("token = ''").groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("mean_len"))
    return held.where("token <> ''"), sizes, n


def weights(freq: DataFrame, sizes: DataFrame, boosts: dict[str, float], n: int) -> DataFrame:
    """BM25 weight of each (document, field, token), all of a document in one of ``n`` tasks."""
    df = freq.groupBy("field", "token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    boost = F.lit(1.0)
    for name, x in boosts.items():
        boost = F.when(F.col("field") == name, x).otherwise(boost)
    stats = small(df.join(F.broadcast(sizes), "field"))  # sizes: a row per field
    return freq.where("allowed").repartition(n, "doc_id").join(stats, ["field", "token"]).select("doc_id", "field", "token", (boost * idf * norm).alias("weight"))


def deletions(term: Column) -> Column:
    """The term and every form of it that lacks one character."""
    n = F.char_length(term)
    return F.array_distinct(F.concat(F.array(term), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(term, F.lit(1), i - 1), F.substr(term, i + 1)))))


def one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(F.char_length(a) - 1, F.lit(1))), lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b)
    return (F.levenshtein(a, b) <= 1) | ((F.char_length(a) == F.char_length(b)) & swapped)


def fuzzy_terms(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term) and (token) to all pairs at most one edit apart, by an equi-join on shared deletions."""
    a = small(terms.select("term").distinct().select("term", F.explode(deletions(F.col("term"))).alias("form")))
    b = vocabulary.select("token").distinct().select("token", F.explode(deletions(F.col("token"))).alias("form"))
    return b.join(a, "form").where(one_edit(F.col("term"), F.col("token"))).select("term", "token").distinct()


def top(scored: DataFrame, limit: int | None = None, *within: str) -> DataFrame:
    """The best ``limit`` documents of each query, or of each query and ``within``, with their position."""
    w = Window.partitionBy("query_id", *within).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("position", F.row_number().over(w)).where(F.col("position") <= clamp(limit))


def bm25(docs: DataFrame, queries: DataFrame, fields: dict[str, Column], every_term: bool, boosts: dict[str, float] | None = None, limit: int | None = None) -> DataFrame:
    """query_id, doc_id, score, position of exact matches of all or any terms."""
    terms = query_terms(queries)
    freq, sizes, n = frequencies(docs, fields, terms.select(F.col("term").alias("token")))
    scored = weights(freq, sizes, boosts or {}, n).join(small(terms.withColumnRenamed("term", "token")), "token")
    if len(fields) > 1:
        scored = scored.groupBy("query_id", "doc_id", "n_terms", "token").agg(F.sum("weight").alias("weight"))
    scored = scored.groupBy("query_id", "doc_id", "n_terms").agg(F.round(F.sum("weight"), 6).alias("score"), F.count("*").alias("found"))
    return top(scored.where(F.col("found") == F.col("n_terms")) if every_term else scored, limit).select("query_id", "doc_id", "score", "position")


def cascade(docs: DataFrame, queries: DataFrame, fields: dict[str, Column], boosts: dict[str, float] | None = None, fuzzy_fields: tuple[str, ...] | None = None, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """query_id, doc_id, score, attempt (1 all terms, 2 all with typos, 3 any), position.

    where: a condition on ``docs``; documents that fail it are no results of any attempt, but count in the statistics."""
    terms = query_terms(queries)
    freq, sizes, n = frequencies(docs, fields, None, where)
    # A vocabulary row per distinct token; only pairs one edit apart leave the join.
    vocabulary = (freq if fuzzy_fields is None else freq.where(F.col("field").isin(*fuzzy_fields))).select("token").distinct()
    near = fuzzy_terms(terms.select("term"), vocabulary).where("term <> token")
    wanted = small(saved(terms.select("term", F.col("term").alias("token")).union(near).distinct(), "wanted"))
    weight = weights(freq.join(small(wanted.select("token").distinct()), "token", "left_semi"), sizes, boosts or {}, n)
    allowed = F.lit(True) if fuzzy_fields is None else F.col("field").isin(*fuzzy_fields)
    exact = F.col("term") == F.col("token")
    hits = weight.join(wanted, "token").where(exact | allowed).groupBy("doc_id", "term").agg(F.sum(F.when(exact, F.col("weight"))).alias("weight"))
    found = hits.join(small(terms), "term").groupBy("query_id", "doc_id", "n_terms").agg(
        F.count("weight").alias("exact"), F.count("*").alias("any"), F.sum("weight").alias("exact_score"), F.sum(F.coalesce("weight", F.lit(FUZZY_SCORE))).alias("any_score"))
    attempt = F.when(F.col("exact") == F.col("n_terms"), 1).when(F.col("any") == F.col("n_terms"), 2).when(F.col("exact") > 0, 3)
    tried = found.withColumn("attempt", attempt).where("attempt is not null")
    score = F.round(F.when(F.col("attempt") == 2, F.col("any_score")).otherwise(F.col("exact_score")), 6)
    # the best of each attempt; the first attempt that has any is the query's
    best = top(tried.select("query_id", "doc_id", score.alias("score"), "attempt"), limit, "attempt")
    return best.withColumn("first", F.min("attempt").over(Window.partitionBy("query_id"))).where("attempt = first").drop("first")


def match_all(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """What the query * returns: any documents, scored alike."""
    return docs.select("doc_id", F.lit(1.0).alias("score")).orderBy("doc_id").limit(clamp(limit))


def listed(values: str | None) -> list[str]:
    """The parts of a comma list: trimmed, lower case, none empty."""
    return [v.strip().lower() for v in (values or "").split(",") if v.strip()]


def in_list(column: Column, values: str | None) -> Column:
    """Filter by a comma list; no values, no filter."""
    wanted = listed(values)
    return F.lower(column).isin(*wanted) if wanted else F.lit(True)


def dedupe_first(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_first = 1").drop("_first")


def lookup(books: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Every request (key in any case) with whether it is known."""
    known = books.select(F.lower(key).alias(key), F.lit(True).alias("known")).distinct()
    return requests.withColumn(key, F.lower(key)).join(known, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))
