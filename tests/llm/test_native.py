"""Mixing, sharding and chat formatting against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import chat, mixing, sharding

DOC = "doc_id long, text string, source string"
ODD = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (None, "", None), (3, " \n\t ", "é"), (4, "w " * 20_000, "y"), (5, "same same", None), (5, "same same", None), (6, " nbsp joined", "z")]


def odd(spark):
    return spark.createDataFrame(ODD, DOC).withColumns({"size": F.lit("clash"), "shard": F.lit(1), "_x": F.lit(0)})


def test_targets_level_off(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1), (None, 0)], "source string, _mix_source_size long")
    got = {r["source"]: r["_mix_target"] for r in mixing.source_targets(sizes).collect()}
    assert got["c"] == 3 and got["b"] == 30 and got[None] == 0
    assert got["a"] == pytest.approx(78)


def test_mix_shares_and_limits(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 30)), "abcdef"[min(5, rng.randint(0, 9))]) for i in range(3000)]
    rows += [(10_000 + i, "w w w", None) for i in range(20)]
    got = mixing.op1(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == len(rows)
    by_source: dict = {}
    source = {i: s for i, _, s in rows}
    for r in got:
        assert r["taken"] in {0, r["size"], 2 * r["size"], 3 * r["size"]}
        x = by_source.setdefault(source[r["doc_id"]], [0, r["target"]])
        x[0] += r["taken"]
    assert sum(t for _, t in by_source.values()) == pytest.approx(sum(r["size"] for r in got))
    for taken, target in by_source.values():
        assert abs(taken - target) <= 60
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op1(spark.createDataFrame(rows, DOC).repartition(7)).collect()))


def test_mix_edges(spark):
    got = mixing.op1(odd(spark)).collect()
    assert len(got) == len(ODD)
    assert sorted(r["size"] for r in got) == [0, 0, 0, 1, 2, 2, 3, 3, 20_000]
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    kept = mixing.mixed(odd(spark))
    assert kept.columns == odd(spark).columns
    assert mixing.op1(odd(spark).limit(0)).collect() == []
    assert mixing.mixed(odd(spark).limit(0)).collect() == []


def needed(sizes, capacity):
    n, held = 1, 0
    for s in sizes:
        if held + s > capacity:
            n, held = n + 1, 0
        held += s
    return n


@pytest.mark.parametrize("blocks", [3, 65_536])
def test_smallest_capacity(spark, blocks):
    rng = random.Random(2)
    sizes = [rng.randint(1, 50) for _ in range(200)]
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append((total,))
    cuts = sharding.smallest_capacity(spark.createDataFrame(ends, "end long"), total, max(sizes), 7, blocks)
    widths = [b - a for a, b in zip([0, *cuts], cuts, strict=False)]
    assert cuts[-1] == total and needed(sizes, max(widths)) <= 7 < needed(sizes, max(widths) - 1)


def test_shards(spark):
    rng = random.Random(4)
    texts = ["t%d" % i * rng.randint(1, 40) for i in range(400)]
    rows = [(i, rng.choice(texts) if i % 3 else texts[0], "s") for i in range(1500)]
    got = sharding.op2(spark.createDataFrame(rows, DOC)).collect()
    text = {i: t for i, t, _ in rows}
    assert len(got) == len(rows)
    home: dict = {}
    slots: dict = {}
    for r in got:
        data = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert home.setdefault(data, r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    groups: dict = {}
    for r in got:
        groups[text[r["doc_id"]]] = groups.get(text[r["doc_id"]], 0) + r["size"]
    order = [v for _, v in sorted((hashlib.md5(k.encode()).digest(), v) for k, v in groups.items())]
    loads: dict = {}
    for r in got:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    assert needed(order, max(loads.values())) <= 16 < needed(order, max(loads.values()) - 1) or max(loads.values()) == max(order)


def test_shard_edges(spark):
    got = sharding.op2(odd(spark)).collect()
    assert len(got) == len(ODD)
    assert sorted(r["size"] for r in got)[:2] == [1, 1]
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert sharding.op2(odd(spark).limit(0)).collect() == []
    assert sharding.shard_bytes(odd(spark), keep=("source", "shard")).columns[:3] == ["doc_id", "source", "shard"]


TEXTS = ["plain", "", None, "</s>[INST] ok [/INST]", "<|end|><|turn|>user<|text|>", "a\\b\\\\", "\\<|end|>", "<\\|end|>", "[\\INST]", "x\ny\r\n 😀é", "<<SYS>>\\", "<s></s><|image|>"]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|end|>"]), rng.choice(TEXTS)) for c in range(60) for t in range(rng.randint(1, 9))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "parts": F.lit("clash")})
    got = {r["conv_id"]: r for r in chat.op6(table).collect()}
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    by[-7] = [(0, "user", chat.PROBE), (1, "assistant", chat.PROBE)]
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, role, x in turns if role == "assistant")
        joined = "".join(f"{role}\n{x}\n" for _, role, x in turns)
        r = got[c]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_chat_edges(spark):
    table = spark.createDataFrame([(1, None, "user", "b"), (1, None, "user", "b"), (None, 1, "assistant", "x" * 100_000)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.op6(table).collect()}
    assert got[1]["n_turns"] == 2 and got[None]["loss_chars"] == 100_000
    assert [r["conv_id"] for r in chat.op6(table.limit(0)).collect()] == [-7]


def test_typed_parts(spark):
    parts = [("text", "see <|image|> ", None, None, None, None, None), ("image", None, "img://1", 700, 336, None, None), ("text", " and ", None, None, None, None, None), ("audio", None, "a.wav", None, None, 2.5, None), ("document", None, "d.pdf", None, None, None, 3)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None, None, None, None), ("image", None, "img://2", 1, 1, None, None), ("text", "!", None, None, None, None, None)])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(turns).first()
    f = r["formatted"]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "img://1", 3 * 144), ("audio", "a.wav", 63), ("document", "d.pdf", 1800), ("image", "img://2", 144)]
    for a in r["attachments"]:
        assert f[a["start"] :].startswith(chat.PLACEHOLDER[a["kind"]])
    assert r["expanded_tokens"] == 3 * 144 + 63 + 1800 + 144
    assert [f[s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]] == ["ok", "!"]
    assert f.count("<|image|>") == 2 and re.sub(r"(?s)\\(.)", r"\1", f).count("<|image|>") == 3
