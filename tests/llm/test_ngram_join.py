"""The n-gram join against all pairs."""

import random
import re

import numpy as np
import pytest

from lectern.llm import kernel as K
from lectern.llm import neardup
from lectern.llm import ngram_join as J

SCHEMA = "doc_id long, text string, n string"


def plain(rows: list[tuple], n: int, percent: int) -> dict:
    """(doc_id, set size) to component ids by comparing all pairs; the texts of one id are linked."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][0], rows[j][0]
            if None not in (a, b) and sets[i] and sets[j] and (a == b or 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    same = {s: least[find(i)] for i, s in enumerate(sets) if s and rows[i][0] is not None}
    return sorted(((str(d), len(sets[i]), least[find(i)] if d is not None else same.get(sets[i])) for i, (d, _) in enumerate(rows)), key=str)


def found(df) -> list:
    return sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def family(rng: random.Random, start: int, many: int, length: int, edits: int, vocabulary: int) -> list[tuple]:
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(length)]
    rows = []
    for k in range(many):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(length)] = f"x{rng.randrange(40)}"
        rows.append((start + k, " ".join(w).upper() if k % 3 else " ".join(w)))
    return rows


@pytest.mark.parametrize("percent", [50, 75, 80, 90, 95, 100])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    small = J.small_sets(percent)
    for _ in range(400):
        n, lack = int(rng.integers(1, 300)), 0
        both = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
        while 100 * n >= percent * (n + lack + 1):
            lack += 1
        more = rng.integers(0, 2**63, lack, dtype=np.int64).astype(np.uint64)
        cut = int(rng.integers(0, lack + 1))
        a, b = np.unique(np.append(both, more[:cut])), np.unique(np.append(both, more[cut:]))
        if not 100 * n >= percent * (n + 1):
            continue
        # classes are a function of the token; no other set has a token of class 0
        weights = rng.dirichlet([0.3, 0.3, 0.3])
        klass = lambda t: 1 + np.searchsorted(np.cumsum(weights), (K.mix64(t) >> np.uint64(11)).astype(float) / 2**53)  # noqa: B023, E731
        kinds = [np.where(np.isin(x, more) & (np.arange(len(x)) % 2 == 0), 0, np.minimum(klass(x), 3)) for x in (a, b)]
        if 100 * n >= percent * len(np.union1d(a, b)):
            assert len(np.intersect1d(J.signatures(a, kinds[0], percent, small), J.signatures(b, kinds[1], percent, small)))


@pytest.mark.parametrize(("n", "percent", "limits"), [(3, 90, (1, 3, 2)), (2, 80, (2, 5, 3)), (1, 50, (1, 2, 2))])
def test_equals_all_pairs(spark, monkeypatch, n, percent, limits):
    monkeypatch.setattr(J, "RARE", limits[0])
    monkeypatch.setattr(J, "OFTEN", limits[1])
    monkeypatch.setattr(neardup, "LISTED", limits[2])
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rng = random.Random(n * percent)
    rows = []
    for k, (many, length, edits) in enumerate([(25, 60, 2), (12, 200, 6), (20, 12, 1), (9, 9, 1), (6, 4, 1), (5, 1, 1), (15, 90, 9)]):
        rows += family(rng, 100 * k, many, length, edits, 30)
    # a passage in texts that are otherwise their own
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(1000 + k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(30 * (k % 3))) + " " + passage) for k in range(30)]
    rng.shuffle(rows)
    assert found(J.jaccard_join(spark.createDataFrame([(*r, "z") for r in rows], SCHEMA), n, percent)) == plain(rows, n, percent)


def test_odd_rows_and_repeated_ids(spark):
    x, y = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    rows = [(3, x + " end"), (5, x), (5, y), (7, y + " end"), (9, None), (9, ""), (10, " \t "), (None, x), (None, "nothing like it"), (None, "nothing like it"), (11, "One two"), (12, "one TWO"), (13, "w " * 30_000), (13, "w " * 30_000), (14, "w w w")]
    wanted = plain(rows, 3, 90)
    assert ("7", 59, 3) in wanted and ("14", 1, 13) in wanted
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        assert found(J.op12(spark.createDataFrame([(*r, "z") for r in order], SCHEMA).repartition(3))) == wanted
    assert J.op12(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        J.jaccard_join(spark.createDataFrame([], SCHEMA), 3, 40)


@pytest.mark.parametrize("limits", [(2, 4)])
def test_near_duplicates_equal_all_pairs_in_any_order(spark, monkeypatch, limits):
    monkeypatch.setattr(neardup, "LISTED", limits[0])
    monkeypatch.setattr(neardup, "BLOCK", limits[1])
    rng = random.Random(limits[0])
    x, y = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    # an id with two texts joins what each of them is near to
    rows = [(3, x + " end"), (5, x), (5, y), (7, y + " end"), (None, x), (None, "nothing like it"), (9, None), (9, ""), (11, "One two"), (12, "one TWO")]
    for k in range(3):
        rows += family(rng, 100 * (k + 1), 25, 120, 3, 40)
    wanted = plain(rows, 4, 80)
    assert ("7", 58, 3) in wanted
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(*r, "z") for r in order], SCHEMA).repartition(3)
        assert found(neardup.op5(docs)) == wanted
    kept = [(r["doc_id"], r["text"]) for r in neardup.one_of_each(docs, 4, 80).collect()]
    assert sorted(d for d, _ in kept if d is not None) == sorted({c for d, _, c in wanted if c is not None and d == str(c)}) and sum(d is None for d, _ in kept) == 2
