"""Answers are asked for once, and not while the model fails."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators.answers import Answers


def test_cache_and_back_off(spark, tmp_path):
    now, asked, mode = [100.0], [], ["answer"]

    def ask(requests, seconds):
        asked.append(sorted(r["md5"] for r in requests.collect()))
        if mode[0] == "fail":
            raise OSError("down")
        return requests.select("key", F.when(F.col("md5") != "late", 0.5).alias("relevance"), F.lit(1).alias("genuine"))

    answers = Answers(spark, f"file://{tmp_path}/a", ask, clock=lambda: now[0])

    def told(*md5s, query="q"):
        rows = answers.of(spark.createDataFrame([(query, m) for m in md5s], "query string, md5 string").withColumn("key", Answers.key(F.col("query"), F.col("md5"))))
        return {r["md5"]: r["relevance"] for r in rows.collect()}

    assert told("a", "b", "b") == {"a": 0.5, "b": 0.5} and asked.pop() == ["a", "b"]
    # only what isn't known is asked, for each query anew
    assert told("a", "c") == {"a": 0.5, "c": 0.5} and asked.pop() == ["c"]
    assert told("a", query="other") == {"a": 0.5} and asked.pop() == ["a"]
    # one late answer stops the questions for a while, known ones are told all the same
    assert told("d", "late") == {"d": 0.5, "late": None} and asked.pop() == ["d", "late"]
    now[0] += 29
    assert told("a", "e") == {"a": 0.5, "e": None} and not asked
    now[0] += 2
    mode[0] = "fail"
    assert told("a", "e") == {"a": 0.5, "e": None} and asked.pop() == ["e"] and answers.backing_off()
    now[0], mode[0] = now[0] + 31, "answer"
    assert told("e") == {"e": 0.5} and told("e") == {"e": 0.5} and asked == [["e"]]
    assert told() == {}


def test_a_batch_is_written_no_more_often_than_needed(spark, tmp_path, monkeypatch):
    from lectern.operators import answers as module

    written = []
    monkeypatch.setattr(module, "frozen", lambda df, f=module.frozen: written.append(df.columns) or f(df))
    kept = Answers(spark, f"file://{tmp_path}/a", lambda asked, _: asked.select("key", F.lit(0.5).alias("relevance"), F.lit(1.0).alias("genuine")))
    rows = kept.of(spark.createDataFrame([("k",), ("l",)], "key string")).collect()
    # the requests, the misses and what was told
    assert {r["relevance"] for r in rows} == {0.5} and len(written) == 3
