"""The pipeline's stages, each on its own input."""

from __future__ import annotations

from collections import Counter

from test_corpus import brute, reachable  # noqa: F401

import corpus_pipeline


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{i}")
        seen[name] = (docs, docs := spark.read.parquet(f"{tmp_path}/{i}"))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    before, after = seen["toxicity"]
    clean = labels.where("toxic = 0").join(before, "doc_id", "left_semi").count()
    assert after.join(labels.where("toxic = 0"), "doc_id", "left_semi").count() >= 0.97 * clean
    before, after = seen["quality rules"]
    kept = {r["doc_id"] for r in after.collect()}
    for r in before.collect():
        n, _, _, _, repeated = brute(r["text"])
        if n < 50 or 100 * repeated > 50 * n:
            assert r["doc_id"] not in kept
    before, after = seen["minhash near-dedup"]
    roots, _ = reachable([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, root in roots.items() if i == root)
    before, after = seen["mixing to target weights"]
    taken = Counter(r["doc_id"] for r in after.collect())
    assert set(taken) <= {r["doc_id"] for r in before.collect()} and max(taken.values()) <= 3
    before, after = seen["best-fit packing"]
    assert Counter(r["doc_id"] for r in after.where("piece = 0").collect()) == taken


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_odd_rows(spark, sf_dir, tmp_path):
    """Nulls, repeats, long texts, clashing columns and empty tables through each stage."""
    good = " ".join(f"{a}{b}" for a in ("stone", "river", "light", "house", "green") for b in range(14))
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (2, None, None, None, None), (None, good + " more", "en", None, 2), (3, "", "", "", 0), (4, "z " * 40_000, "en", "s", 3), (5, good + " end", None, "s", 4)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    odd = odd.withColumns({"kept": F.lit("clash"), "key": F.lit(1), "part": F.lit(2), "size": F.lit(3), "length": F.lit(4), "root": F.lit(5)})
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf_dir)
        out[name] = got.collect()
        if name != "best-fit packing":
            assert got.columns == odd.columns
        assert stage(spark, odd.limit(0), sf_dir).collect() == []
    ids = {name: Counter(r["doc_id"] for r in out[name]) for name in out}
    assert ids["toxicity"] == Counter([1, 1, 2, None, 3, 4, 5])
    assert not {2, 3, 4} & set(ids["quality rules"])
    assert ids["minhash near-dedup"] == Counter([1, 2, None, 3, 4])
    assert not {2, 3} & set(ids["mixing to target weights"]) and max(ids["mixing to target weights"].values()) <= 6
    first = Counter(r["doc_id"] for r in out["best-fit packing"] if r["piece"] == 0)
    assert first == ids["toxicity"] and len({(r["sequence_id"], r["offset"]) for r in out["best-fit packing"]}) == len(out["best-fit packing"])
