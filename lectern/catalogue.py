"""The catalogue as a library: what its HTTP endpoints and commands offered, as calls on DataFrames."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import index, maintain, rank, search, stage
from lectern.sources import api_pages, binary, sqldump
from lectern.streaming import incremental

#: Results that are ranked before the rest is appended in the order of relevance.
RERANK = 24
FUZZY_FIELDS = ("title", "author", "series")
#: Columns of the five tables; a dump's own names of ``topic`` and ``main_id`` begin with its prefix.
COLUMNS = {
    "editions": ["e_id", "topic", "visible", "title", "author", "series_name", "publisher", "year"], "editions_add_descr": ["e_add_id", "e_id", "key", "value"],
    "editions_to_files": ["f_id", "e_id"], "files": ["f_id", "main_id", "fiction_id", "topic", "extension", "visible", "broken", "md5", "filesize", "pages"], "elem_descr": ["key", "name_en"],
}
_NUMBERS = {"e_id", "e_add_id", "key", "f_id", "main_id", "fiction_id", "filesize", "pages"}


class Catalogue:
    """Books in a versioned table, with search, lookups, imports and incremental updates."""

    def __init__(self, spark: SparkSession, folder: str, topics: tuple[str, ...] = ("f", "l"), extensions: tuple[str, ...] = stage.EXTENSIONS, catch_up_days: int = incremental.CATCH_UP_DAYS):
        self.spark, self.topics, self.extensions, self.catch_up_days = spark, topics, extensions, catch_up_days
        self.store = maintain.BucketStore(spark, folder, "md5")
        fields = {"title": F.col("title"), "author": F.col("author"), "series": F.col("series"), "publisher": F.col("publisher"), "isbn": F.array_join("isbn", " ")}
        self.index = index.Index(spark, f"{folder.rstrip('/')}/index", fields, "md5", search.BOOSTS, FUZZY_FIELDS)

    def books(self) -> DataFrame:
        books = self.store.read()
        if books is None:
            raise LookupError("no books yet: import a dump first")
        return books

    # ------------------------------------------------------------- reading

    def search(self, q: str, ext: str | None = None, lang: str | None = None, limit: int | None = None, answers: DataFrame | None = None, library: DataFrame | None = None) -> DataFrame:
        """Ranked books. answers: (md5, relevance, genuine) of a model; library: (md5) of the files at hand."""
        if not q.strip():
            raise ValueError("an empty query")
        limit = search.clamp(limit)
        books, wanted = self.books().withColumn("doc_id", F.col("md5")), search.in_list(F.col("extension"), ext) & search.in_list(F.col("language"), lang)
        if q.strip() == "*":
            found = search.match_all(books.where(wanted), max(limit, RERANK))
        else:
            queries = self.spark.range(1).select(F.lit(0).alias("query_id"), F.lit(q).alias("query"))
            self._catch_up()
            filtered = any(search.listed(x) for x in (ext, lang))
            found = self.index.cascade(queries, max(limit, RERANK), books.where(wanted) if filtered else None).drop("query_id", "position")
        hits = books.join(F.broadcast(found), "doc_id").withColumns({"bm25": F.col("score"), "query_id": F.lit(0)}).drop("score")  # at most 100 rows
        hits = search.dedupe_first(hits, "md5", [F.desc("bm25")])
        if answers is not None:
            answers = answers.withColumnRenamed("md5", "doc_id").withColumn("query_id", F.lit(0))
        ranked = rank.rerank(hits, RERANK, limit, answers)
        at_hand = (library if library is not None else self.spark.createDataFrame([], "md5 string")).select("md5", F.lit(True).alias("in_library")).distinct()
        return ranked.join(at_hand, "md5", "left").withColumn("in_library", F.coalesce("in_library", F.lit(False))).drop("doc_id", "query_id").orderBy("position")

    def get(self, md5: str) -> DataFrame:
        return self.books().where(F.col("md5") == md5.lower()).limit(1)

    def contains(self, md5: str) -> bool:
        return not self.get(md5).isEmpty()

    def status(self) -> dict:
        current = self.store.load_state("current")
        if current:
            self._catch_up()
        return {"documents": self.index.documents(), "version": current.get("version"), **self.store.load_state()}

    def _catch_up(self) -> None:
        """Builds the index anew if it isn't that of the current books: a writer may have ended between the two."""
        version = self.store.load_state("current").get("version")
        if self.index.state().get("books") != version:
            self.index.build(self.books(), books=version)

    def health(self) -> dict:
        return {"ok": bool(self.store.load_state("current"))}

    def verify(self) -> dict:
        """A self-check: any book is found by its key, by the first words of its title, and by *."""
        book = self.books().where("title <> ''").orderBy("md5").first()
        if book is None:
            raise LookupError("the table has no titled book")
        words = " ".join(book["title"].split()[:4])
        return {"documents": self.books().count(), "lookup": self.contains(book["md5"].upper()), "search": not self.search(words).isEmpty(), "all": not self.search("*").isEmpty()}

    # ------------------------------------------------------------- writing

    def import_tables(self, tables: dict[str, DataFrame], source: str, language_key: int = stage.LANGUAGE_KEY, isbn_key: int = stage.ISBN_KEY, least_books: int | None = None) -> dict:
        """Replaces a source's books by those of the five tables; the old version stays on an error, and if there are too few books."""
        typed = {n: df.select(*[F.col(c).try_cast("long").alias(c) if c in _NUMBERS else F.col(c) for c in df.columns]) for n, df in tables.items()}
        descriptors = typed["editions_add_descr"].withColumnRenamed("e_add_id", "seq")
        keys = {"editions": "e_id", "files": "f_id"}
        # rows of a dump know their place in it; of other tables' rows the order is Spark's own
        place = list(sqldump.PLACE)
        typed = {n: df if "_file" in df.columns else df.select("*", F.lit("").alias("_file"), F.lit(0).alias("_block"), F.monotonically_increasing_id().alias("_line"), F.lit(0).alias("_row")) for n, df in typed.items()}
        last = {n: stage.last_by_key(typed[n], [k], place).drop(*place) for n, k in keys.items()}
        descriptors = descriptors.drop(*place)
        typed["editions_to_files"] = typed["editions_to_files"].drop(*place)
        new = stage.books(last["editions"], descriptors, typed["editions_to_files"], last["files"], source, self.topics, self.extensions, language_key, isbn_key)
        old = self.store.read()
        version = self.store.publish((new if old is None else maintain.replace_source(old, new, source)).dropDuplicates(["md5"]), least_books)
        self.index.build(self.books(), books=version)
        state = self.store.load_state()
        ids = {r["topic"]: r["max_id"] + 1 for r in stage.max_ids(typed["files"], {"l": "main_id", "f": "fiction_id"}).collect() if not self.topics or r["topic"] in self.topics}
        state.setdefault("next_file_ids", {}).update(ids)
        state.setdefault("sources", {})[source] = {"bootstrapped": True}
        self.store.save_state(state)
        return state

    def import_dump(self, path: str, source: str, prefix: str = "") -> dict:
        """Imports a text dump that holds the tables. prefix: what its columns *topic and, for main_id, *id begin with."""
        own = {"topic": f"{prefix}topic", "main_id": f"{prefix}id"} if prefix else {}
        defined = sqldump.definitions(self.spark, path)
        tables = {n: sqldump.read_dump(self.spark, path, n, [own.get(c, c) for c in columns], defined=defined, with_place=True).toDF(*columns, *sqldump.PLACE) for n, columns in COLUMNS.items() if n != "elem_descr"}
        return self.import_tables(tables, source)

    def import_binary(self, folder: str, source: str, prefix: str = "") -> dict:
        """Imports binary tables, three files each. A table with fewer or more rows than its index says is an error, and the books stay as they are."""
        own, tables = {"topic": f"{prefix}topic", "main_id": f"{prefix}id"} if prefix else {}, {}
        for name, columns in COLUMNS.items():
            if name == "elem_descr":
                continue
            rows, layout = binary.read_table(self.spark, folder, name, [own.get(c, c) for c in columns], stage.VALUE_BYTES if name == "editions_add_descr" else None)
            tables[name] = binary.check_rows(stage.frozen(rows.select(*[own.get(c, c) for c in columns]).toDF(*columns)), layout)
        return self.import_tables(tables, source)

    def changed_books(self, file_pages: DataFrame, edition_pages: DataFrame, sources: dict[str, str], prefix: str = "") -> tuple[DataFrame, DataFrame]:
        """(removals, upserts) of pages of changed files and of their editions. sources: topic to source; prefix: of the topic field."""
        r = F.col("record")
        files = api_pages.records(file_pages).select(*[api_pages.text(r, c).alias(c) for c in ("md5", "extension", "visible", "broken")], api_pages.text(r, f"{prefix}topic").alias("topic"), *[api_pages.number(r, c).alias(c) for c in ("filesize", "pages")], api_pages.related_ids(r, "editions", "e_id").alias("edition_ids"))
        files = files.where(F.col("topic").isin(*sources))
        known = self.store.read()
        known = known.select("md5") if known is not None else self.spark.createDataFrame([], "md5 string")
        changes = incremental.classify(files, known, self.extensions)
        new = changes.where("change = 'new'").withColumn("file", F.col("md5"))
        editions = api_pages.records(edition_pages).select(F.col("id").try_cast("long").alias("e_id"), *[api_pages.text(r, c).alias(c) for c in ("visible", "title", "author", "series_name", "publisher", "year")], api_pages.descriptors(r, stage.LANGUAGE_KEY).alias("languages"), api_pages.descriptors(r, stage.ISBN_KEY).alias("numbers"))
        of = new.join(incremental.lowest_eligible(new, editions), "file").join(editions.drop("visible"), "e_id", "left")
        source = F.element_at(F.create_map(*[F.lit(x) for kv in sources.items() for x in kv]), F.col("topic"))
        upserts = of.where("title is not null").select(
            "md5", "title", "author", F.col("series_name").alias("series"), "publisher", "year", F.lower(F.coalesce(F.get("languages", F.lit(0)), F.lit(""))).alias("language"), F.lower("extension").alias("extension"),
            "filesize", "pages", F.transform("numbers", lambda x: F.regexp_replace(x, "[- ]", "")).alias("isbn"), source.alias("source"))
        removals = changes.where("change = 'removal'").select("md5").union(of.where("title is null").select("md5"))
        return removals, upserts

    def refresh(self, file_pages: DataFrame, edition_pages: DataFrame, sources: dict[str, str], today: datetime.date | None = None, prefix: str = "") -> dict:
        """Applies pages of changes and moves the day cursor to today, which is asked again next time."""
        removals, upserts = self.changed_books(file_pages, edition_pages, sources, prefix)
        self.apply(removals, upserts)
        state = self.store.load_state()
        state["synced_until"] = (today or datetime.date.today()).isoformat()
        self.store.save_state(state)
        return self.status()

    def apply(self, removals: DataFrame, upserts: DataFrame) -> None:
        """Removals (md5), then upserts: rewrites the buckets of books that they touch and adds a small segment to the index."""
        if self.store.read() is None:
            self.index.build(upserts, books=self.store.publish(upserts))
            return
        self._catch_up()
        upserts = stage.frozen(upserts)
        removals = stage.frozen(removals.select(F.lower("md5").alias("md5")))
        gone = stage.frozen(self.store.of(upserts.select("md5").unionByName(removals)))
        if not self.store.change(removals, upserts):
            return
        version = self.store.load_state("current")["version"]
        self.index.apply(gone, upserts, books=version)
        self.index.merge(self.books(), books=version)

    def days_due(self, today: datetime.date) -> list[datetime.date]:
        """Days that an update asks for, none older than the catch-up."""
        until = datetime.date.fromisoformat(self.store.load_state().get("synced_until", "1970-01-01"))
        first = max(until, today - datetime.timedelta(days=self.catch_up_days))
        return [first + datetime.timedelta(days=k) for k in range((today - first).days + 1)]
