"""Periodic runs against a plain search of all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lectern.llm import periodic


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    """(start, length, period) by trying each period at each place; the least period is looked up in the stretch itself."""
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            part = w[i : j + q]
            if j > i and len(part) >= max(6, 4 * q) and not any(all(part[k] == part[k + p] for k in range(len(part) - p)) for p in range(1, q)):
                out.add((i, len(part), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text) -> dict:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    return {
        "doc_id": doc_id, "n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in dropped).encode()).hexdigest(),
    }


def random_words(rng: random.Random) -> list[int]:
    w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 90))]
    if rng.random() < 0.5:
        w = (w[: rng.randint(1, 9)] * rng.randint(1, 9) + w[3:5] * rng.randint(1, 20)) * rng.randint(1, 4)
    return w


def test_runs_equal_a_plain_search():
    rng = random.Random(5)
    for _ in range(120):
        texts = [random_words(rng) for _ in range(rng.randint(1, 6))]
        words, at = np.array([x for t in texts for x in t], np.int64), np.cumsum([0, *map(len, texts)])
        found = list(zip(*(c.tolist() for c in periodic.runs_of(words, at)), strict=True))
        assert found == [(t, *r) for t, w in enumerate(texts) for r in plain_runs(w)]


def test_slabs_do_not_matter(monkeypatch):
    words, at = np.array([1, 2, 3] * 40 + [1] * 50 + [1, 2] * 30), np.array([0, 230])
    whole = [c.tolist() for c in periodic.runs_of(words, at)]
    monkeypatch.setattr(periodic, "SLAB", 7)
    assert [c.tolist() for c in periodic.runs_of(words, at)] == whole


@pytest.mark.parametrize("size", [1, 2, 500, 4000])
def test_extensions_of_long_periods(size):
    words = np.array([*range(size)] * 5 + [-3])
    assert [c.tolist() for c in periodic.runs_of(np.unique(words, return_inverse=True)[1], np.array([0, len(words)]))] == ([[], [], [], []] if size == 1 else [[0], [0], [5 * size], [size]])


def test_fewer_than_three_periods_are_refused():
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(9, np.int64), np.array([0, 9]), periods=2)


def test_query_equals_a_plain_search(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{x}é" for x in random_words(rng))) for i in range(300)]
    rows += [(None, "a a a a a a a"), (901, None), (902, ""), (903, " \t\n "), (904, "x y " * 30), (904, "x y " * 30), (905, "tick\x0btock\x0c" * 2000)]
    docs = spark.createDataFrame([(*r, "b") for r in rows], "doc_id long, text string, runs string")
    found = [r.asDict() for r in periodic.op13(docs).collect()]
    wanted = [plain_row(*r) for r in rows]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    assert sorted(found, key=key) == sorted(wanted, key=key)
    assert periodic.op13(docs.limit(0)).collect() == []


def test_query_equals_a_plain_search_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000")
    found = {r["doc_id"]: r.asDict() for r in periodic.op13(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert found == {r["doc_id"]: plain_row(r["doc_id"], r["text"]) for r in rows} and any(r["n_runs"] for r in found.values())
