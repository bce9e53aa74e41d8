"""Packed records, null bits and errors of binary tables."""

from __future__ import annotations

import struct

import pytest

from lectern.sources import binary
from test_sources import block


def layout(*fields, bitmap=None, checksum=False):
    fields = [binary.FieldDef(*f) for f in fields]
    bits = sum(f.kind in (1, 2, 3, 4) for f in fields)
    return binary.Layout(True, 0, sum(f.length for f in fields), -(-bits // 8) if bitmap is None else bitmap, checksum, fields)


def values(record, where):
    return [v for _, v in binary.unpack(record, where)]


def test_packings():
    where = layout((1, 4), (2, 4), (3, 2), (4, 9))
    assert values(b"\x07\x01a\x01b\x02xy", where) == [b"a   ", b"   b", b"\0\0", b"xy"]
    assert values(b"\x08aaaabbbbcc", where) == [b"aaaa", b"bbbb", b"cc", b""]
    assert values(b"\x01\xac\x02" + b"q" * 300, layout((1, 400))) == [b"q" * 300 + b" " * 100]
    assert values(b"\xff\x01\x2c" + b"l" * 300 + b"\xff" + b"s" * 255, layout((8, 1026), (8, 256))) == [b"l" * 300, b"s" * 255]


@pytest.mark.parametrize(("record", "where"), [
    (b"", layout((1, 4))), (b"\1\5abcde", layout((1, 4))), (b"\2ab", layout((8, 2))), (b"\3ab", layout((8, 10))), (b"\2abc", layout((8, 10))), (b"\2ab", layout((8, 10), checksum=True)),
    (b"\0a", layout((3, 1), bitmap=0)), (b"\0\1a", layout((4, 8))), (b"a", layout((5, 1)))])
def test_broken_records(record, where):
    with pytest.raises(binary.TableError):
        binary.unpack(record, where)


def test_nulls_and_checksum():
    where = layout((0, 1), (8, 10, 2, 0), checksum=True)
    assert values(b"\2\0\x99", where) == [b"\2", None] and values(b"\0\2ok\x99", where) == [b"\0", b"ok"]


def test_rows_of_linked_blocks(spark, tmp_path):
    where = layout((0, 1), (3, 4), (8, 21, 1, 0), (8, 21), (0, 1))
    columns = [binary.ColumnDef("id", 1, 4, 3), binary.ColumnDef("a", 5, 21, 15), binary.ColumnDef("b", 26, 21, 253), binary.ColumnDef("kind", 47, 1, 247, ["x", "y"])]
    one, two = b"\0\0\7\0\0\0\2a \4long\2", b"\1\1\0\1z\0"
    data = block(5, one[:6], len(one)) + block(7, one[6:]) + block(1, two)
    (tmp_path / "t").write_bytes(data)
    read = lambda **more: sorted(map(tuple, binary.read_rows(spark, str(tmp_path / "t"), columns, where, **more).collect()), key=repr)
    assert read() == [(0, None, "z", ""), (7, "a ", "long", "y")]
    assert read(select=["kind", "id"]) == [(0, ""), (7, "y")]
    assert read(select=["b"], value_limit=3) == [("z",), (None,)] or read(select=["b"], value_limit=3) == [(None,), ("z",)]
    with pytest.raises(binary.TableError):
        read(select=["nope"])
    with pytest.raises(binary.TableError):
        binary.read_rows(spark, "x", [*columns, binary.ColumnDef("c", 90, 1, 1)], where)
    with pytest.raises(binary.TableError):
        binary.read_rows(spark, "x", columns[:2], where)


def test_over_long_and_shared_parts(spark, tmp_path):
    tail = block(7, b"tail")
    (tmp_path / "long").write_bytes(block(5, b"ab", 5) + tail)
    with pytest.raises(Exception, match="more bytes"):
        binary.read_linked(spark, str(tmp_path / "long")).collect()
    (tmp_path / "shared").write_bytes(tail + block(5, b"ab", 6, 0) + block(5, b"cd", 6, 0))
    with pytest.raises(binary.TableError, match="two records"):
        binary.read_linked(spark, str(tmp_path / "shared")).collect()


def test_null_bits_of_fixed_tables(spark, tmp_path):
    fields = [binary.FieldDef(0, 1), binary.FieldDef(0, 2, 2, 0), binary.FieldDef(0, 3, 4, 0), binary.FieldDef(0, 1, 8, 0)]
    columns = [binary.ColumnDef("n", 1, 2, 2), binary.ColumnDef("t", 3, 3, 254), binary.ColumnDef("e", 6, 1, 247, ["x"])]
    (tmp_path / "t").write_bytes(b"\x01\5\0ab \1" + b"\x0f\0\0   \0" + b"\x00\1\0zz \1" + b"\x05\1\1   \0")
    rows = binary.read_fixed(spark, str(tmp_path / "t"), columns, binary.Layout(False, 3, 7, fields=fields))
    assert sorted(map(tuple, rows.collect()), key=repr) == [(257, None, ""), (5, "ab", "x"), (None, None, None)]
    (tmp_path / "bad").write_bytes(b"\x01\5\0ab \2")
    with pytest.raises(Exception, match="no label 2"):
        binary.read_fixed(spark, str(tmp_path / "bad"), columns, binary.Layout(False, 1, 7, fields=fields)).collect()
    (tmp_path / "none").write_bytes(b"")
    assert binary.read_fixed(spark, str(tmp_path / "none"), columns, binary.Layout(False, 0, 7, fields=fields)).count() == 0


def test_index_header():
    fields = [(0, 1, 0, 0), (3, 4, 0, 0), (8, 10, 2, 0)]
    base, size = 40, 100
    keys, uniques = bytes([2]) + bytes(11) + bytes(36), bytes([1]) + bytes(3) + bytes(18)
    data = bytearray(base + size) + keys + uniques + b"".join(struct.pack(">hHBH", *f) for f in fields)
    data[:4], data[18], data[19] = b"\xfe\xfe\x07\x01", 1, 1
    for form, at, value in ((">H", 4, 33), (">H", 6, len(data)), (">H", 10, size), (">H", 12, base), (">Q", 28, 9), (">I", base + 44, 15), (">I", base + 64, 3), (">H", base + 76, 1)):
        struct.pack_into(form, data, at, value)
    assert binary.parse_index_header(bytes(data)) == binary.Layout(True, 9, 15, 1, True, [binary.FieldDef(*f) for f in fields])
    struct.pack_into(">I", data, base + 44, 16)
    with pytest.raises(binary.TableError):
        binary.parse_index_header(bytes(data))
    struct.pack_into(">I", data, base + 64, 99)
    with pytest.raises(binary.TableError):
        binary.parse_index_header(bytes(data))
