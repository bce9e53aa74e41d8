"""The trie of conversation beginnings against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lectern.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        whole = tuple(turns.get(family, [])[:h] + mine[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)

    def below(k):
        saved, leaves = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0), not children[k]
        for x in children[k]:
            s, n = below(x)
            saved, leaves = saved + s, leaves + n
        return saved, leaves

    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), *reversed(below(k)), hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


def nodes(df) -> list[tuple]:
    return sorted((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def random_rows(rng: random.Random, n: int) -> list[tuple]:
    rows = []
    for c in rng.sample(range(-150, 400), n):
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]), rng.choice(["", None, "hé", "a longer text", "x"])))
    rows += rng.sample(rows, 10)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "ids", "hot"), [(1024, 4096, 10_000), (2, 3, 2), (3, 1, 10**9)])
def test_equals_a_plain_trie(spark, monkeypatch, block, ids, hot):
    monkeypatch.setattr(prefixes, "BLOCK", block)
    monkeypatch.setattr(prefixes, "HOT_PARENTS", hot)
    rng = random.Random(block)
    rows = random_rows(rng, 120)
    # one conversation repeated under many ids, one with many turns, one that has turns of other ids at its beginning
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1080) for t in range(3)] + [(2000, t, "a", "b" * (t % 7)) for t in range(300)] + [(2001, t, "a", "b" * (t % 7)) for t in range(280)]
    rows += [(None, 1, "user", "no id"), (3001, 1, "user", "alone")]
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", x int")
    assert nodes(prefixes.op11(df)) == plain_trie(rows)


def test_no_conversations_no_nodes(spark):
    assert prefixes.op11(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ids_that_are_no_numbers_take_no_part(spark):
    df = spark.createDataFrame([("7", 1, "user", "a"), ("x", 1, "user", "b")], "conv_id string, turn long, role string, text string")
    assert {r["conv_id"] for r in prefixes.op11(df).collect()} == {7}


def test_end_lists_are_hashed_string_by_string(spark):
    ends = spark.createDataFrame([(5, 6, 2, i) for i in range(10_000)] + [(5, 7, 2, -3), (5, 7, 2, 11)], "x long, y long, depth long, conv_id long")
    found = {(r["x"], r["y"]): r["ends_sha256"] for r in prefixes.end_hashes(ends).collect()}
    assert found == {(5, 6): hashlib.sha256(",".join(map(str, range(10_000))).encode()).hexdigest(), (5, 7): hashlib.sha256(b"-3,11").hexdigest()}
