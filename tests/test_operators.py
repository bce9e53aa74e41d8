from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import maintain, rank, search, stage
from lectern.streaming import incremental


def keys(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize(("a", "b", "near"), [("form", "from", True), ("form", "farm", True), ("form", "forms", True), ("form", "orm", True), ("form", "frmo", False), ("abcd", "badc", False), ("a", "b", True), ("ab", "ba", True)])
def test_one_edit(spark, a, b, near):
    assert spark.range(1).select(search.one_edit(F.lit(a), F.lit(b)).alias("x")).first()["x"] is near
    terms, tokens = spark.createDataFrame([(a,)], "term string"), spark.createDataFrame([(b,)], "token string")
    assert (search.fuzzy_terms(terms, tokens).count() == 1) is near


def test_cascade(spark):
    docs = spark.createDataFrame([(1, "red apple pie", "en"), (2, "green aple", "en"), (3, "apple", "de"), (4, "grape", "en")], "doc_id long, text string, lang string")
    queries = spark.createDataFrame([(1, "red apple"), (2, "green apple"), (3, "grape zebra"), (4, "nothing")], "query_id long, query string")
    found = search.cascade(docs, queries, {"text": F.col("text")})
    assert keys(found, "query_id", "attempt", "doc_id") == [(1, 1, 1), (2, 2, 2), (3, 3, 4)]
    german = search.cascade(docs, queries, {"text": F.col("text")}, where=search.in_list(F.col("lang"), "DE,"))
    assert keys(german, "query_id", "attempt", "doc_id") == [(1, 3, 3), (2, 3, 3)]
    assert search.match_all(docs, 2).count() == 2
    assert [search.clamp(x) for x in (None, 0, 7, 1000)] == [40, 1, 7, 100]


@pytest.mark.parametrize(("ext", "size", "fit"), [("epub", 0, 0.8 + 0.12), ("epub", 10_000, 0.84), ("epub", 70 << 20, 0.92), ("pdf", 90 << 20, 0.28 + 0.1), ("zip", 1 << 20, 0.36)])
def test_ereader_fit(spark, ext, size, fit):
    assert spark.range(1).select(rank.ereader_fit(F.lit(ext), F.lit(size)).alias("x")).first()["x"] == pytest.approx(fit)


def test_rerank_head_and_tail(spark):
    rows = [("q", i, 10.0 - i, "t", "a", "1", "e", "p", "epub" if i == 2 else "djvu", 1 << 20) for i in range(5)]
    results = spark.createDataFrame(rows, "query_id string, doc_id long, bm25 double, title string, author string, year string, language string, publisher string, extension string, filesize long")
    assert [r["doc_id"] for r in rank.rerank(results, window=3, limit=4).orderBy("position").collect()] == [2, 0, 1, 3]
    answers = spark.createDataFrame([("q", 1, 1.0, 1.0)], "query_id string, doc_id long, relevance double, genuine double")
    scored = {r["doc_id"]: r["score"] for r in rank.rerank(results, 3, 5, answers).collect()}
    assert scored[1] == pytest.approx(0.3 * 0.9 + 0.35 + 0.35 * (0.12 + 0.2))
    assert spark.range(1).select(rank.genuine(F.lit("A Summary of X"), F.lit("a")).alias("x")).first()["x"] == 0.2


@pytest.mark.parametrize(("p", "score", "wanted"), [([0.0, 0.0, 1.0], 2, 1.0), ([], 1, 0.5), ([], 3, 1.0), ([0.5, 0.5, 0.0], 9, 0.25)])
def test_expected_level(spark, p, score, wanted):
    c = rank.expected_level(F.array(*map(F.lit, p)).cast("array<double>"), F.lit(score), 3)
    assert spark.range(1).select(c.alias("x")).first()["x"] == pytest.approx(wanted)


def test_log_sum_exp(spark):
    assert spark.range(1).select(rank.log_sum_exp(F.array(F.lit(1000.0), F.lit(1000.0))).alias("x")).first()["x"] == pytest.approx(1000.693147)


def catalogue(spark):
    editions = spark.createDataFrame([(1, "f", "", " Blank hidden ", "A"), (2, "f", "no", "hidden", "B"), (3, "a", "", "article", "C"), (4, "f", "", "  ", "D"), (5, "l", None, "kept", "E")], "e_id long, topic string, visible string, title string, author string")
    editions = editions.withColumns({c: F.lit("") for c in ("series_name", "publisher", "year")})
    descr = spark.createDataFrame([(1, 101, " English ", 1), (1, 101, "French", 2), (1, 505, "978-0 1", 3), (1, 505, "-", 4), (5, 101, "x" * 65, 5), (5, 305, "note", 6)], "e_id long, key long, value string, seq long")
    links = spark.createDataFrame([(10, 2), (10, 5), (10, 1), (11, 3), (12, 1)], "f_id long, e_id long")
    md5 = "0123456789ABCDEF0123456789ABCDEF"
    files = spark.createDataFrame([(10, "f", "EPUB", "", "N", md5, 5, 7), (11, "f", "epub", "", "N", md5, 1, 1), (12, "f", "epub", "", "Y", md5, 1, 1), (13, "f", "zip", "", "N", md5, 1, 1), (14, "f", "epub", "", "N", "short", 1, 1)],
                                  "f_id long, topic string, extension string, visible string, broken string, md5 string, filesize long, pages long")
    return editions, descr, links, files


def test_books(spark):
    rows = stage.books(*catalogue(spark), source="s", topics=("f", "l")).collect()
    assert len(rows) == 1
    r = rows[0].asDict()
    assert (r["md5"], r["title"], r["language"], r["isbn"], r["extension"], r["filesize"]) == ("0123456789abcdef0123456789abcdef", "Blank hidden", "english", ["97801"], "epub", 5)
    assert stage.books(*catalogue(spark), source="s").count() == 2  # no topics, no restriction


def test_changes(spark):
    books = spark.createDataFrame([("a", "s1", 1), ("b", "s1", 2), ("c", "s2", 3)], "md5 string, source string, n long")
    new = spark.createDataFrame([("b", "s2", 9), ("d", "s1", 4)], "md5 string, source string, n long")
    gone = spark.createDataFrame([("A",), ("d",)], "md5 string")
    once = maintain.apply_changes(books, gone, new, "md5")
    assert keys(once, "md5", "n") == [("b", 9), ("c", 3), ("d", 4)]
    assert keys(maintain.apply_changes(once, gone, new, "md5"), "md5", "n") == keys(once, "md5", "n")
    assert keys(maintain.replace_source(books, new.where("source = 's1'"), "s1"), "md5") == [("c",), ("d",)]


def test_publish_keeps_current_version(spark, tmp_path):
    store = maintain.Store(spark, f"file://{tmp_path}/store")
    assert store.read() is None
    store.publish(spark.range(3))
    with pytest.raises(ValueError, match="stays"):
        store.publish(spark.range(1), least_rows=2)
    assert store.read().count() == 3
    store.save_state({"next": {"f": 73}})
    assert store.load_state() == {"next": {"f": 73}}


def test_classify(spark):
    md5 = "a" * 32
    rows = [(md5.upper(), "", "", "epub"), ("b" * 32, "", "", "pdf"), ("c" * 32, "no", "", "pdf"), ("d" * 32, "", "Y", "pdf"), ("e" * 32, "", "", "zip"), ("short", "", "", "pdf"), (None, None, None, None)]
    changes = incremental.classify(spark.createDataFrame(rows, "md5 string, visible string, broken string, extension string"), spark.createDataFrame([(md5,)], "md5 string"))
    assert sorted(r["change"] for r in changes.collect()) == ["ignored", "ignored", "new", "removal", "removal", "removal", "unchanged"]


def test_lowest_eligible(spark):
    files = spark.createDataFrame([("a", [10, 9, 100]), ("b", [8]), ("c", [])], "file string, edition_ids array<long>")
    editions = spark.createDataFrame([(9, "no", "t"), (10, "", "t"), (100, "", "t"), (8, "", "")], "e_id long, visible string, title string")
    assert keys(incremental.lowest_eligible(files, editions), "file", "e_id") == [("a", 10), ("b", None), ("c", None)]


def test_windows_and_days(spark):
    ids = spark.createDataFrame([("f", i) for i in (1, 5, 12, 45, 120)], "topic string, id long")
    got = incremental.windows(ids, 10)
    # the next window begins behind the last id that was found, empty ones are a page wide
    assert keys(got, "window_start", "rows", "next_id") == [(0, 2, 6), (43, 1, 46), (6, 1, 13)]
    assert keys(incremental.windows(ids, 10, most_empty=8), "window_start", "rows", "next_id") == [(0, 2, 6), (116, 1, 121), (43, 1, 46), (6, 1, 13)]


@pytest.mark.parametrize(("page", "walked"), [(1, 10**6), (3, 10**6), (10, 0), (64, 0)])
def test_windows_equal_a_walk(spark, monkeypatch, page, walked):
    monkeypatch.setattr(incremental, "WALKED", walked)
    rng = random.Random(page)
    ids = [(t, rng.choice([rng.randint(0, 60), rng.randint(0, 900), 300 + rng.randint(0, 40)])) for t in "fl" for _ in range(120)]
    wanted = []
    for t in "fl":
        own, after, gap = [i for x, i in ids if x == t and i >= 7], 7, 0
        while gap <= 3:
            start = after + gap * page
            found = [i for i in own if start <= i < start + page]
            if not found:
                gap += 1
                continue
            gap, after = 0, max(found) + 1
            wanted.append((t, start, len(found), after))
    got = incremental.windows(spark.createDataFrame(ids, "topic string, id long"), page, start=7)
    assert sorted(map(tuple, got.select("topic", "window_start", "rows", "next_id").collect())) == sorted(wanted)
    days = spark.range(1).select(incremental.days_to_replay(F.lit("2024-01-01").cast("date"), F.lit("2024-01-10").cast("date")).alias("d")).first()["d"]
    assert (str(days[0]), str(days[-1]), len(days)) == ("2024-01-03", "2024-01-10", 8)


def test_resolve_key_and_max_ids(spark):
    names = spark.createDataFrame([(7, "Language of x"), (9, "language"), (3, "Language")], "key long, name_en string")
    assert stage.resolve_key(names, "LANGUAGE").first()["key"] == 3
    assert keys(stage.max_ids(spark.createDataFrame([(3, None), (None, -1)], "a long, b long"), {"l": "a", "f": "b"}), "topic", "max_id") == [("l", 3)]
