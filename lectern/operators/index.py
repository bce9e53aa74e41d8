"""A stored inverted index: search without analysing texts.

An index is a list of segments in a folder; a pointer file names the current ones
(one rename makes a new list current). A segment holds

- ``postings``: a row for each field, token and block of documents, with the
  block's documents, frequencies and field lengths as arrays, and with the greatest
  frequency and least length, from which the block's best score follows whatever
  the corpus's statistics are. Rows lie in buckets of tokens (folders), sorted by
  token, so that few terms read few row groups; a token with very many blocks is
  spread over several files of its bucket;
- ``terms``: document frequencies of its tokens, negative where it takes documents
  away, so that sums over segments are exact;
- ``forms``: each token's forms with one character missing, for typo-tolerant terms;
- ``dead``: keys whose documents in earlier segments are gone.

Documents of a segment are dealt to blocks by a hash of their key. Applying changes
writes one small segment and rewrites nothing; when there are many segments, or
many dead keys, those of like size are merged.

Searches take many queries at once and work on blocks before they open any: a
conjunction opens blocks that have all terms; a disjunction first scores each
query's most promising blocks, takes the score of the last wanted hit as a
threshold, and opens only blocks whose best scores add up to it.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import analyze
from lectern.operators import search
from lectern.operators.maintain import Store
from lectern.scratch import saved

#: Documents of a block, about, and folders of tokens.
BLOCK, BUCKETS = 128, 16
#: So many distinct terms are looked up by literal values, which prune folders and row groups; more by a join.
PRUNED = 64
#: Rows of queries, terms and dead keys are broadcast up to this count.
BROADCAST_ROWS = search.BROADCAST_ROWS
#: Bytes of text whose postings one task sorts and writes, tokens whose rows it does, and blocks that one task of a search or merge gets, about.
SORTED, WORDS, SPREAD = 32 << 20, 500_000, 64
#: What rounding can move a score.
MARGIN = 2e-6
#: Segments of like size that are merged into one, and the share of dead documents from which all are.
MERGED, DEAD_SHARE = 4, 0.2
#: Columns of a segment's parts.
PARTS = {
    "postings": "token string, field string, block long, n int, max_tf int, min_len int, words long, docs array<{key}>, tfs array<int>, lens array<int>, bucket int",
    "terms": "bucket int, token string, field string, df long, words long", "forms": "bucket int, form string, token string", "dead": "doc {key}",
}


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    return search.small(df, most)


def _forms(words: DataFrame, name: str) -> DataFrame:
    """Each word with itself and with what is left of it without one character."""
    at = F.explode(F.sequence(F.lit(0), F.char_length(name))).alias("i")
    return words.select(name, at).select(name, F.concat(F.substr(name, F.lit(1), F.col("i") - 1), F.substr(name, F.col("i") + 1)).alias("form"))


class Index:
    """fields: what is searched, as expressions on the documents; boosts: their weights; fuzzy_fields: those that take typos (all)."""

    def __init__(self, spark: SparkSession, folder: str, fields: dict[str, Column], key: str = "doc_id", boosts: dict[str, float] | None = None, fuzzy_fields: tuple[str, ...] | None = None, block: int = BLOCK, buckets: int = BUCKETS):
        self.spark, self.folder, self.fields, self.key, self.boosts, self.fuzzy_fields, self.block, self.buckets = spark, folder.rstrip("/"), fields, key, boosts or {}, fuzzy_fields, block, buckets
        self.store = Store(spark, folder)

    # ------------------------------------------------------------- writing

    def segments(self) -> list[dict]:
        return self.store.load_state("index").get("segments", [])

    def _publish(self, segments: list[dict], **more) -> None:
        """Makes the list current. Segments that leave it stay for those who still read it, until the next change."""
        before = self.state()
        kept = {s["name"] for s in segments}
        retired = [s["name"] for s in before.get("segments", []) if s["name"] not in kept]
        self.store.save_state({"segments": segments, "retired": retired, **more}, "index")
        for name in before.get("retired", []):
            path = self.store._path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def state(self) -> dict:
        return self.store.load_state("index")

    def _bucket(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _frequencies(self, docs: DataFrame, blocks: int, tasks: int) -> DataFrame:
        """doc, block, field, token, len, tf. Texts are dealt by block once, to tasks of bounded size; all that follows stays in place."""
        block = F.pmod(F.xxhash64(F.col(self.key)), F.lit(blocks))
        each = F.array(*[F.struct(F.lit(name).alias("field"), analyze(F.col(f"_{name}")).alias("tokens")) for name in self.fields])
        dealt = docs.select(F.col(self.key).alias("doc"), block.alias("block"), *[c.alias(f"_{name}") for name, c in self.fields.items()]).repartition(tasks, "block")
        rows = dealt.select("doc", "block", F.explode(each).alias("f")).select("doc", "block", "f.field", F.size("f.tokens").alias("len"), F.explode("f.tokens").alias("token"))
        return rows.groupBy("block", "field", "token", "doc", "len").agg(F.count("*").cast("int").alias("tf"))

    def _clustered(self, rows: DataFrame, by: str, tasks: int, *order: str) -> DataFrame:
        """Rows of each bucket in as many tasks as it takes, dealt by ``by`` and sorted: what a task sorts doesn't grow with the index."""
        spread = max(1, -(-tasks // self.buckets))
        place = F.col("bucket") * spread + F.pmod(F.xxhash64(by, F.lit(1)), F.lit(spread))
        return rows.repartitionById(self.buckets * spread, place.cast("int")).sortWithinPartitions("bucket", *order)

    def _write_postings(self, freq: DataFrame, path: str, number: int, tasks: int) -> None:
        """Rows of (block, field, token) with arrays, clustered by token."""
        rows = freq.groupBy("block", "field", "token").agg(F.sort_array(F.collect_list(F.struct("doc", "tf", "len"))).alias("p"))  # at most about a block's documents
        rows = rows.select(
            "token", "field", (F.lit(number).cast("long") * F.lit(1 << 40) + F.col("block")).alias("block"), F.size("p").alias("n"), F.array_max("p.tf").alias("max_tf"), F.array_min("p.len").alias("min_len"),
            F.aggregate("p.tf", F.lit(0).cast("long"), lambda a, x: a + x).alias("words"), F.col("p.doc").alias("docs"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens"), self._bucket(F.col("token")).alias("bucket"))
        # a token in every document has a row for each block: they are dealt by block
        self._clustered(rows, "block", tasks, "token", "field", "block").write.partitionBy("bucket").parquet(f"{path}/postings")

    def _write(self, docs: DataFrame, gone: DataFrame | None = None, dead: DataFrame | None = None) -> dict:
        """One segment of ``docs``; gone: the documents, as they were indexed, of the keys ``dead``."""
        number = time.time_ns() // 1000 % (1 << 22)
        taken = {s["number"] for s in self.segments()}
        while number in taken:
            number = (number + 1) % (1 << 22)
        name = f"segment-{number}-{time.time_ns()}"
        path, n = f"{self.folder}/{name}", docs.count()
        segment = {"name": name, "number": number, "key": dict(docs.dtypes)[self.key], "n": n, "gone": 0, "words": {}, "dead": dead is not None}
        blocks = max(1, -(-n // self.block))
        texts = list(self.fields.values())
        tasks = min(blocks, search.tasks(docs, texts))
        self._write_postings(self._frequencies(docs, blocks, tasks), path, number, min(tasks, search.tasks(docs, texts, SORTED)))
        added = self._read(segment, "postings").groupBy("bucket", "token", "field").agg(F.sum("n").cast("long").alias("df"), F.sum("words").alias("words"))
        if gone is not None:
            segment["gone"] = gone.count()
            few = max(1, -(-segment["gone"] // self.block))
            lost = self._frequencies(gone, few, min(few, search.tasks(gone, texts))).groupBy("token", "field").agg((-F.count("*")).alias("df"), (-F.sum("tf")).alias("words")).withColumn("bucket", self._bucket(F.col("token")))
            added = added.unionByName(lost).groupBy("bucket", "token", "field").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))
        added = saved(added.select("bucket", "token", "field", "df", "words"), "terms")
        many = -(-added.count() // WORDS)
        self._clustered(added, "token", many, "token", "field").write.parquet(f"{path}/terms")
        terms = self._read(segment, "terms")
        sums = {r["field"]: r["words"] for r in terms.groupBy("field").agg(F.sum("words").alias("words")).collect()}  # a row per field
        fuzzy = terms if self.fuzzy_fields is None else terms.where(F.col("field").isin(*self.fuzzy_fields))
        forms = _forms(fuzzy.where("df > 0").select("token").distinct(), "token")
        self._clustered(forms.withColumn("bucket", self._bucket(F.col("form"))), "form", 8 * many, "form").select("bucket", "form", "token").write.parquet(f"{path}/forms")
        if dead is not None:
            dead.write.parquet(f"{path}/dead")
        return segment | {"words": {f: int(sums.get(f) or 0) for f in self.fields}}

    def build(self, docs: DataFrame, **more) -> dict:
        """Makes ``docs`` (one row a key) the whole index. more: what the pointer file shall say besides."""
        segment = self._write(docs)
        self._publish([segment], **more)
        return segment

    def apply(self, gone: DataFrame, new: DataFrame, **more) -> dict:
        """Takes the documents ``gone`` away and adds ``new``, as one small segment.

        gone: rows of the keys that are removed or replaced, as they were indexed; it may hold keys that are not indexed no more than once."""
        if not self.segments():
            return self.build(new, **more)
        dead = gone.select(F.col(self.key).alias("doc")).distinct()
        segment = self._write(new, gone, dead)
        self._publish([*self.segments(), segment], **more)
        return segment

    def merge(self, current: DataFrame, **more) -> int:
        """Puts segments together if there are too many, or too many dead documents; ``current``: all documents. Returns how many are left.

        Segments without dead keys that are neighbours and of like size are joined block by block, without analysis; with too
        many dead documents the index is built anew."""
        segments = self.segments()
        total = sum(s["n"] for s in segments)
        if total and sum(s["gone"] for s in segments) > DEAD_SHARE * total:
            self.build(current, **more)
            return 1
        run = self._run(segments)
        if run:
            at, n = run
            self._publish([*segments[:at], self._joined(segments[at : at + n]), *segments[at + n :]], **{k: v for k, v in self.state().items() if k not in ("segments", "retired")} | more)
        return len(self.segments())

    @staticmethod
    def _run(segments: list[dict]) -> tuple[int, int] | None:
        """The first run of MERGED neighbours of which none is four times as large as another."""
        for at in range(len(segments) - MERGED + 1):
            sizes = [max(1, s["n"] + s["gone"]) for s in segments[at : at + MERGED]]
            if max(sizes) <= 4 * min(sizes):
                return at, MERGED
        return None

    def _joined(self, segments: list[dict]) -> dict:
        """One segment of several neighbours: live postings as they are, dead keys for those before them."""
        name = f"segment-{segments[-1]['number']}-{time.time_ns()}"
        path = f"{self.folder}/{name}"
        rows = self._live(self._rows("postings", segments), segments)
        if any(s["dead"] for s in segments[1:]):
            rows = rows.where(F.size("docs") > 0)
        terms = self._rows("terms", segments).groupBy("bucket", "token", "field").agg(F.sum("df").alias("df"), F.sum("words").alias("words")).where("df <> 0 or words <> 0")
        many = -(-terms.count() // WORDS)
        blocks = sum(-(-s["n"] // self.block) for s in segments)
        self._clustered(rows.drop("segment"), "block", max(many, blocks // SPREAD), "token", "field", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
        self._clustered(terms, "token", many, "token", "field").write.parquet(f"{path}/terms")
        self._clustered(self._rows("forms", segments).select("bucket", "form", "token").distinct(), "form", 8 * many, "form").write.parquet(f"{path}/forms")
        dead = [s for s in segments if s["dead"]]
        if dead:
            self._rows("dead", dead).select("doc").distinct().write.parquet(f"{path}/dead")
        return {
            "name": name, "number": segments[-1]["number"], "key": segments[-1]["key"], "n": sum(s["n"] for s in segments), "gone": sum(s["gone"] for s in segments),
            "words": {f: sum(s["words"][f] for s in segments) for f in self.fields}, "dead": bool(dead)}

    # ------------------------------------------------------------- reading

    def _read(self, segment: dict, part: str) -> DataFrame:
        return self.spark.read.schema(PARTS[part].format(key=segment["key"])).parquet(f"{self.folder}/{segment['name']}/{part}")

    def _rows(self, part: str, segments: list[dict] | None = None) -> DataFrame:
        out = None
        for i, s in enumerate(self.segments() if segments is None else segments):
            df = self._read(s, part).withColumn("segment", F.lit(i))
            out = df if out is None else out.unionByName(df)
        if out is None:
            raise LookupError("the index has no segment")
        return out

    def _live(self, rows: DataFrame, segments: list[dict] | None = None) -> DataFrame:
        """Postings rows (segment, docs, tfs, lens, n ...) without documents that a later segment took away."""
        segments = self.segments() if segments is None else segments
        with_dead = [i for i, s in enumerate(segments) if s["dead"] and i > 0]
        if not with_dead:
            return rows
        dead = None
        for i in with_dead:
            df = self._read(segments[i], "dead").select("doc", F.lit(i).alias("since"))
            dead = df if dead is None else dead.unionByName(df)
        dead = _small(dead.groupBy("doc").agg(F.max("since").alias("since")))
        columns = [c for c in rows.columns if c not in ("docs", "tfs", "lens", "n", "words", "max_tf", "min_len")]
        each = rows.select(*columns, F.explode(F.arrays_zip("docs", "tfs", "lens")).alias("p")).select(*columns, F.col("p.docs").alias("doc"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))
        each = each.join(dead, "doc", "left").where(F.col("since").isNull() | (F.col("segment") >= F.col("since"))).groupBy(*columns).agg(F.sort_array(F.collect_list(F.struct("doc", "tf", "len"))).alias("p"))
        return each.select(
            *columns, F.size("p").alias("n"), F.array_max("p.tf").alias("max_tf"), F.array_min("p.len").alias("min_len"), F.aggregate("p.tf", F.lit(0).cast("long"), lambda a, x: a + x).alias("words"),
            F.col("p.doc").alias("docs"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens"))

    def _of(self, part: str, tokens: DataFrame, by: str = "token") -> DataFrame:
        """Rows of a part whose token (or form) is among ``tokens``."""
        wanted = tokens.select(by).distinct()
        some = [r[0] for r in wanted.limit(PRUNED + 1).collect()]
        if len(some) <= PRUNED:
            values = self.spark.createDataFrame([(x,) for x in some], f"{by} string")
            folders = [r[0] for r in values.select(self._bucket(F.col(by))).distinct().collect()]
            return self._rows(part).where(F.col("bucket").isin(folders) & F.col(by).isin(some))
        return self._rows(part).join(_small(wanted), by, "left_semi")

    def _tasks(self) -> int:
        """Into how many tasks postings are dealt by block, so that each gets a bounded number of blocks."""
        blocks = sum(-(-s["n"] // self.block) for s in self.segments())
        return max(1, min(blocks, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // SPREAD))))

    def documents(self) -> int:
        return sum(s["n"] - s["gone"] for s in self.segments())

    def sizes(self) -> DataFrame:
        """One row per field: documents and mean length."""
        n = self.documents()
        rows = [(n, f, sum(s["words"][f] for s in self.segments()) / n if n else 0.0) for f in self.fields]
        return self.spark.createDataFrame(rows, "n long, field string, mean_len double")

    def vocabulary(self) -> DataFrame:
        """token, field, df of all tokens that documents have."""
        return self._rows("terms").groupBy("token", "field").agg(F.sum("df").alias("df")).where("df > 0")

    def factors(self, tokens: DataFrame) -> DataFrame:
        """token, field, factor (boost times inverse document frequency), mean_len of the tokens that documents have."""
        df = self._of("terms", tokens).groupBy("token", "field").agg(F.sum("df").alias("df")).where("df > 0")
        boost = F.lit(1.0)
        for name, x in self.boosts.items():
            boost = F.when(F.col("field") == name, x).otherwise(boost)
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return df.join(F.broadcast(self.sizes()), "field").select("token", "field", (boost * idf).alias("factor"), "mean_len")  # a row per field

    def fuzzy(self, terms: DataFrame) -> DataFrame:
        """(term) to (term, token), at most one edit apart, of the tokens that fields with typos have."""
        asked = self._saved(_forms(terms.select("term").distinct(), "term"), "forms")
        met = self._of("forms", asked, "form").select("form", "token").distinct().join(_small(asked), "form")
        met = met.where(search.one_edit(F.col("term"), F.col("token"))).select("term", "token").distinct()
        if len(self.segments()) == 1:
            return met
        # a token whose last document is gone is no longer one
        have = self._of("terms", met) if self.fuzzy_fields is None else self._of("terms", met).where(F.col("field").isin(*self.fuzzy_fields))
        return met.join(have.groupBy("token").agg(F.sum(F.greatest("df", F.lit(0))).alias("has"), F.sum("df").alias("df")).where("df > 0").select("token"), "token", "left_semi")

    # ----------------------------------------------------------- searching

    def _asked(self, terms: DataFrame, near: DataFrame | None = None) -> DataFrame:
        """query_id, n_terms, term, token, exact, field, factor, mean_len, saved: what each query looks for in which field."""
        if near is None:
            wanted = terms.select("query_id", "n_terms", "term", F.col("term").alias("token"), F.lit(True).alias("exact"))
        else:
            pairs = terms.select("term", F.col("term").alias("token")).unionByName(near).distinct()
            wanted = terms.join(pairs, "term").select("query_id", "n_terms", "term", "token", (F.col("term") == F.col("token")).alias("exact"))
        asked = wanted.join(self.factors(wanted), "token")
        if self.fuzzy_fields is not None:
            asked = asked.where(F.col("exact") | F.col("field").isin(*self.fuzzy_fields))
        return _small(self._saved(asked.select("query_id", "n_terms", "term", "token", "exact", "field", "factor", "mean_len"), "asked"))

    def _saved(self, df: DataFrame, tag: str) -> DataFrame:
        return saved(df, tag)

    def _heads(self, asked: DataFrame, rows: DataFrame) -> DataFrame:
        """query_id, n_terms, block, terms (how many it has), best (what a document of it can score at most), n (postings): arrays aren't read."""
        norm = _norm(F.col("max_tf"), F.col("min_len"), F.col("mean_len"))
        met = rows.select("token", "field", "block", "n", "max_tf", "min_len").join(asked, ["token", "field"])
        return met.groupBy("query_id", "n_terms", "block").agg(
            F.size(F.collect_set("term")).alias("terms"), F.sum(F.when(F.col("exact"), F.col("factor") * norm).otherwise(0.0)).alias("best"), F.sum("n").cast("long").alias("n"))

    def _scored(self, asked: DataFrame, rows: DataFrame, open_: DataFrame | None, where: DataFrame | None) -> DataFrame:
        """query_id, n_terms, doc_id, exact, any, exact_score, any_score of the documents in open blocks (query_id, block), or in all.

        A document's postings all lie in its block: rows are dealt by block while they are arrays, and summed up where they are."""
        met = rows.select("token", "field", "block", "segment", "docs", "tfs", "lens").repartition(self._tasks(), "block").join(asked, ["token", "field"])
        if open_ is not None:
            met = met.join(_small(open_.select("query_id", "block")), ["query_id", "block"], "left_semi")
        each = met.select("block", "query_id", "n_terms", "term", "exact", "factor", "mean_len", F.explode(F.arrays_zip("docs", "tfs", "lens")).alias("p"))
        weight = F.when(F.col("exact"), F.col("factor") * _norm(F.col("p.tfs"), F.col("p.lens"), F.col("mean_len")))
        each = each.select("block", "query_id", "n_terms", "term", F.col("p.docs").alias("doc_id"), weight.alias("weight"))
        if where is not None:
            each = each.join(where, "doc_id", "left_semi")
        hits = each
        if len(self.fields) > 1 or self._with_typos(asked):
            hits = each.groupBy("block", "query_id", "n_terms", "doc_id", "term").agg(F.sum("weight").alias("weight"))
        return hits.groupBy("block", "query_id", "n_terms", "doc_id").agg(
            F.count("weight").alias("exact"), F.count("*").alias("any"), F.round(F.sum("weight"), 6).alias("exact_score"), F.round(F.sum(F.coalesce("weight", F.lit(search.FUZZY_SCORE))), 6).alias("any_score"))

    @staticmethod
    def _with_typos(asked: DataFrame) -> bool:
        return not asked.where("not exact").isEmpty()

    def _conjunction(self, terms: DataFrame, where: DataFrame | None, near: DataFrame | None = None) -> DataFrame:
        asked = self._asked(terms, near)
        rows = self._live(self._of("postings", asked))
        open_ = self._saved(self._heads(asked, rows).where("terms = n_terms"), "heads")
        return self._scored(asked, rows, open_, where).where(F.col("exact" if near is None else "any") == F.col("n_terms")).select("query_id", "doc_id", F.col("exact_score" if near is None else "any_score").alias("score"))

    def _disjunction(self, terms: DataFrame, where: DataFrame | None, limit: int, report: dict | None = None) -> DataFrame:
        asked = self._asked(terms)
        rows = self._live(self._of("postings", asked))
        if report is None and sum(-(-s["n"] // self.block) for s in self.segments()) <= 2 * limit:
            # as many blocks as would set the threshold
            return self._scored(asked, rows, None, where).select("query_id", "doc_id", F.col("exact_score").alias("score"))
        heads = self._saved(self._heads(asked, rows), "heads")
        # each of the best blocks has a document that may come near its best score
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best"), "block"))
        seeds = heads.withColumn("rank", rank).where(F.col("rank") <= limit)
        first = self._scored(asked, rows, seeds, where)
        last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact_score")))
        least = self._saved(first.withColumn("rank", last).where(F.col("rank") == limit).select("query_id", F.col("exact_score").alias("least")), "thresholds")
        open_ = heads.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("best") >= F.col("least") - MARGIN))
        if report is not None:
            report |= {"postings": heads.agg(F.sum("n")).first()[0], "read": open_.agg(F.sum("n")).first()[0], "blocks": heads.count(), "opened": open_.count()}
        return self._scored(asked, rows, open_, where).select("query_id", "doc_id", F.col("exact_score").alias("score"))

    def _allowed(self, where: DataFrame | None) -> DataFrame | None:
        return None if where is None else _small(where.select(F.col(self.key).alias("doc_id")).distinct())

    def bm25(self, queries: DataFrame, every_term: bool, limit: int | None = None, where: DataFrame | None = None, report: dict | None = None) -> DataFrame:
        """query_id, doc_id, score, position of exact matches of all or any terms. where: documents (key) that may be results; report: gets counts of postings."""
        terms, where = self._saved(search.query_terms(queries), "terms"), self._allowed(where)
        found = self._conjunction(terms, where) if every_term else self._disjunction(terms, where, search.clamp(limit), report)
        return search.top(found, limit).select("query_id", "doc_id", "score", "position")

    def cascade(self, queries: DataFrame, limit: int | None = None, where: DataFrame | None = None) -> DataFrame:
        """query_id, doc_id, score, attempt (1 all terms, 2 all with typos, 3 any), position; each attempt is made for the queries that have no result yet."""
        left, out, where = self._saved(search.query_terms(queries), "terms"), None, self._allowed(where)
        for attempt in (1, 2, 3):
            if attempt > 1 and left.isEmpty():
                break
            if attempt == 3:
                found = self._disjunction(left, where, search.clamp(limit))
            else:
                near = None if attempt == 1 else self._saved(self.fuzzy(left), "near")
                found = self._conjunction(left, where, near)
            found = self._saved(search.top(found, limit).select("query_id", "doc_id", "score", F.lit(attempt).alias("attempt"), "position"), f"attempt-{attempt}")
            out = found if out is None else out.unionByName(found)
            left = self._saved(left.join(_small(found.select("query_id").distinct()), "query_id", "left_anti"), "left")
        return out


def _norm(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * length / mean))
