"""What one task sorts of an index doesn't grow with the index."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from lectern.operators import index as I
from lectern.operators import search


def test_buckets_are_written_and_merged_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "SORTED", 400, raising=False)
    monkeypatch.setattr(I, "WORDS", 8, raising=False)
    monkeypatch.setattr(I, "SPREAD", 2, raising=False)
    rows = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 9))) for i in range(64)]
    frame = lambda rs: spark.createDataFrame(rs, "doc_id long, text string")
    index = I.Index(spark, f"file://{tmp_path}/i", {"text": F.col("text")}, block=4, buckets=2)
    index.build(frame(rows[:16]))
    first = Path(tmp_path, "i", index.segments()[0]["name"])
    assert all(len(list(first.glob(f"{part}/*.parquet"))) > 2 for part in ("terms", "forms"))
    assert len(list(first.glob("postings/bucket=0/*.parquet"))) > 1
    for at in (16, 32, 48):
        index.apply(frame([]), frame(rows[at : at + 16]))
    assert index.merge(frame(rows)) == 1 and index.documents() == 64
    asked = spark.createDataFrame([(1, "w3 w5"), (2, "w7 w11 w99")], "query_id int, query string")
    found = index.bm25(asked, False).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, search.bm25(frame(rows), asked, {"text": F.col("text")}, False).collect())) and found
