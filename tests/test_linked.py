"""Records of many parts are read whole."""

from __future__ import annotations

import random

import pytest

from lectern.sources import binary
from test_sources import block


@pytest.mark.parametrize("n", [3, 66])
def test_records_of_many_parts(spark, tmp_path, n):
    texts = [bytes([65 + r]) * 2 + bytes(range(48, 58)) * 40 for r in range(3)]
    size = len(block(12, b"xx"))
    data = b""
    for r, text in enumerate(texts):
        at = len(data)
        whole = 2 * n
        first = block(13, text[:2], whole, at + len(block(13, b"xx")) + (n - 2) * size)
        # the parts lie backwards
        data += first + b"".join(reversed([block(12, text[2 * k : 2 * k + 2], 0, at + len(first) + (n - 1 - (k + 1)) * size if k < n - 1 else 2**64 - 1) for k in range(1, n)]))
    path = tmp_path / "t.myd"
    path.write_bytes(data + block(1, b"single"))
    got = sorted(bytes(r["record"]) for r in binary.read_linked(spark, str(path)).collect())
    assert got == sorted([t[: 2 * n] for t in texts] + [b"single"])


def test_record_cut_after_many_parts_is_an_error(spark, tmp_path):
    size, head = len(block(12, b"x")), len(block(13, b"x"))
    data = block(13, b"x", 200, head) + b"".join(block(12, b"x", 0, head + (k + 1) * size) for k in range(80))
    (tmp_path / "t.myd").write_bytes(data)
    with pytest.raises(binary.TableError):
        binary.read_linked(spark, str(tmp_path / "t.myd")).collect()


@pytest.mark.parametrize("range_size", [40, 200, 1000, 1 << 20])
def test_ranges_give_the_same_records(spark, tmp_path, range_size):
    """Blocks in any order, longer than a range, deleted ones, and payloads full of bytes that look like blocks."""
    rng = random.Random(range_size)
    records = [bytes(rng.choice([1, 3, 7, 0, 65, rng.randrange(256)]) for _ in range(rng.choice([5, 30, 90, 700]))) for _ in range(60)]
    # each record in parts; the parts of all records are laid out in random order
    parts = []
    for r, text in enumerate(records):
        size = rng.choice([len(text), 20, 64])
        cuts = list(range(0, len(text), size))
        parts += [(r, k, text[at : at + size], k == len(cuts) - 1) for k, at in enumerate(cuts)]
    rng.shuffle(parts)
    head = {True: 13, False: 12}
    places, at = {}, 0
    for r, k, payload, _ in parts:
        places[r, k] = at
        at += len(block(head[k == 0], payload, 0, 1)) + (24 if (r + k) % 5 == 0 else 0)
    data = b""
    for r, k, payload, last in parts:
        assert len(data) == places[r, k]
        data += block(head[k == 0], payload, len(records[r]) if k == 0 else 0, 2**64 - 1 if last else places[r, k + 1])
        if (r + k) % 5 == 0:
            data += b"\0" + (24).to_bytes(3, "big") + bytes(20)
    (tmp_path / "a.myd").write_bytes(data)
    (tmp_path / "b.myd").write_bytes(block(1, b"other file"))
    got = sorted(bytes(r["record"]) for r in binary.read_linked(spark, str(tmp_path), range_size).collect())
    assert got == sorted([*records, b"other file"])
    if range_size == 200:
        starts = binary.entries(spark, binary.ranges(spark, str(tmp_path / "a.myd"), 200))
        assert len(starts) > 10 and {s[-1] for s in starts} <= set(places.values()) | {p + 24 for p in range(len(data))}


def test_a_wrong_block_in_any_range_is_an_error(spark, tmp_path):
    good = b"".join(block(1, bytes([65 + i % 20]) * 30) for i in range(50))
    (tmp_path / "t.myd").write_bytes(good + b"\x0f" + good)
    with pytest.raises(Exception, match="unknown block type 15|bad block length"):
        binary.read_linked(spark, str(tmp_path / "t.myd"), 300).collect()


@pytest.mark.parametrize("range_size", [60, 1 << 20])
def test_scan_statistics(spark, tmp_path, range_size):
    gone = b"\0" + (24).to_bytes(3, "big") + bytes(20)
    data = b"".join(block(1, b"whole record") + block(13, b"abcd", 12) + block(12, b"efgh") + block(7, b"ijkl") + gone for _ in range(20))
    (tmp_path / "s.myd").write_bytes(data)
    found = binary.scan_statistics(spark, str(tmp_path / "s.myd"), range_size).collect()
    assert [tuple(r)[1:] for r in found] == [(40, 20, 40, 20, len(data))]
    assert binary.read_linked(spark, str(tmp_path / "s.myd"), range_size).count() == 40


def test_ranges_are_small_enough_for_several_tasks_of_an_executor(spark, tmp_path):
    (tmp_path / "t").write_bytes(bytes(20 << 20))
    assert max(hi - lo for *_, lo, hi in binary.ranges(spark, f"file://{tmp_path}/t")) <= 8 << 20
