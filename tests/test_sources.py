from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from lectern.sources import api_pages, binary, discovery, sqldump

DUMP = r"""CREATE TABLE `shelves` (
  `place` int,
);
INSERT INTO `shelves` VALUES (40),(41),(42);
CREATE TABLE `loans` (
  `loan` int NOT NULL,
  `reader` varchar(20),
  `fee` decimal(5,2),
  PRIMARY KEY (`loan`)
);
INSERT INTO `loans` VALUES (17,'O\'Hara; Lee',12.75),(18,'\\ ''quoted''',-0.5),(19,'',NULL);
INSERT INTO `loans` VALUES (20,'\0\n\r\t\b\Z\y',Null);
"""


def write(path, text):
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def test_dump_values(spark, tmp_path):
    rows = sqldump.read_dump(spark, write(tmp_path / "d.sql", DUMP), "loans").orderBy("loan").collect()
    assert [tuple(r) for r in rows] == [("17", "O'Hara; Lee", "12.75"), ("18", "\\ 'quoted'", "-0.5"), ("19", "", None), ("20", "\0\n\r\t\b\x1ay", None)]


def test_dump_raw_carriage_return_columns_and_limit(spark, tmp_path):
    path = write(tmp_path / "d.sql", DUMP.replace("O\\'H", "a\rb"))
    assert sqldump.read_dump(spark, path, "loans", ["reader"]).filter("reader like 'a\rb%'").count() == 1
    assert sqldump.read_dump(spark, path, "loans", ["fee", "loan"]).columns == ["fee", "loan"]
    assert sqldump.read_dump(spark, path, "loans", limit=2).count() == 2


def test_dump_errors(spark, tmp_path):
    with pytest.raises(sqldump.DumpError):
        sqldump.read_dump(spark, write(tmp_path / "a.sql", "INSERT INTO `t` VALUES (1);\n"), "t")
    with pytest.raises(sqldump.DumpError):
        sqldump.read_dump(spark, write(tmp_path / "b.sql", DUMP), "loans", ["nope"])
    for line in ("INSERT INTO `t` VALUES (1,'x", "INSERT INTO `t` VALUES (1", "INSERT INTO `t` VALUES 1"):
        with pytest.raises(sqldump.DumpError):
            list(sqldump.tuples(line, 2))


def test_dump_round_trip(spark, tmp_path):
    rows = [("a'b\\c\n\r\x1a", None), ("", "x,(y)"), ("NULL", "é")]
    path = str(tmp_path / "out")
    sqldump.write_dump(spark.createDataFrame(rows, "a string, b string"), "t", path)
    assert sorted(map(tuple, sqldump.read_dump(spark, path, "t").collect()), key=repr) == sorted(rows, key=repr)


def definition(columns: list[tuple[str, int, int, int]], labels: list[list[str]] = ()) -> bytes:
    """A definition file of (name, width, type, label group)."""
    names = b"\xff" + b"\xff".join(n.encode() for n, *_ in columns) + b"\xff\0"
    groups = b"".join(b"\xff" + b"\xff".join(x.encode() for x in g) + b"\xff\0" for g in labels)
    groups = groups + b"\0" if groups else b""
    form = bytearray(288)
    struct.pack_into("<H", form, 258, len(columns))
    struct.pack_into("<H", form, 268, len(names))
    struct.pack_into("<H", form, 274, len(groups))
    meta, at = bytearray(), 1
    for _, width, kind, group in columns:
        m = bytearray(17)
        m[3:5] = width.to_bytes(2, "little")
        m[5:8] = (at + 1).to_bytes(3, "little")
        m[12], m[13] = group, kind
        meta += m
        at += width
    head = bytearray(68)
    head[:2] = b"\xfe\x01"
    struct.pack_into("<I", head, 64, 68)
    return bytes(head + form + meta + names + groups)


def test_fixed_table(spark, tmp_path):
    columns = binary.parse_definition(definition([("id", 4, 3, 0), ("kind", 1, 247, 1), ("flags", 1, 248, 2), ("name", 5, 254, 0)], [["a", "b"], ["x", "y", "z"]]))
    assert [c.name for c in columns] == ["id", "kind", "flags", "name"]
    record = lambda used, i, k, f, n: bytes([used]) + i.to_bytes(4, "little") + bytes([k, f]) + n.ljust(5).encode()
    path = write(tmp_path / "t.myd", record(1, 7, 2, 5, "abc") + record(0, 1, 1, 1, "gone") + record(1, 4_000_000_000, 0, 0, "b"))
    layout = binary.Layout(False, 2, 12)
    rows = binary.read_fixed(spark, path, columns, layout).collect()
    assert tuple(rows[0]) == (7, "b", "x,z", "abc")
    assert tuple(rows[1]) == (4_000_000_000, "", "", "b")
    binary.check_rows(binary.read_fixed(spark, path, columns, layout), layout)
    with pytest.raises(binary.TableError):
        binary.check_rows(binary.read_fixed(spark, path, columns, layout), binary.Layout(False, 3, 12))


def block(kind: int, payload: bytes, whole: int = 0, pointer: int = 2**64 - 1) -> bytes:
    _, record, length, padding, pointed = binary.BLOCKS[kind]
    return bytes([kind]) + whole.to_bytes(record, "big") * bool(record) + len(payload).to_bytes(length, "big") + b"\2" * padding + pointer.to_bytes(8, "big") * pointed + payload + b"\0\0" * padding


@pytest.mark.parametrize("head", [5, 6, 13])
@pytest.mark.parametrize("tail", [7, 8, 9, 10])
@pytest.mark.parametrize("middle", [11, 12])
def test_blocks_all_layouts(head, middle, tail):
    parts = [block(head, b"ab", 6, 100), block(middle, b"cd", 0, 7), block(tail, b"ef")]
    found = list(binary.blocks_of(b"".join(parts)))
    assert [f[3] for f in found] == [b"ab", b"cd", b"ef"] and [f[1] for f in found] == [True, False, False]
    assert found[0][2] == 6 and found[0][4] == 100 and found[1][4] == 7


def test_linked_records(spark, tmp_path):
    deleted = b"\0" + (20).to_bytes(3, "big") + b"\0" * 16
    first = block(1, b"whole")
    tail_at = len(deleted) + len(first)
    tail = block(7, b"ward")
    head_at = tail_at + len(tail)
    backward = block(5, b"back", 8, tail_at)
    forward_size = len(block(5, b"for", 7, 0))
    forward = block(5, b"for", 7, head_at + len(backward) + forward_size)
    data = deleted + first + tail + backward + forward + block(9, b"ward")
    rows = binary.read_linked(spark, write(tmp_path / "t.myd", data)).collect()
    assert sorted(bytes(r["record"]) for r in rows) == [b"backward", b"forward", b"whole"]
    with pytest.raises(binary.TableError):
        binary.read_linked(spark, write(tmp_path / "u.myd", block(5, b"x", 3, 999))).collect()


def test_binary_errors():
    for data in (b"", b"\xfe\x01", b"xx" * 100):
        with pytest.raises(binary.TableError):
            binary.parse_definition(data)
    with pytest.raises(binary.TableError):
        binary.parse_index_header(b"\0" * 200)
    with pytest.raises(binary.TableError):
        list(binary.blocks_of(b"\x0f123"))


def test_discovery(spark):
    names = ["d_2024-01-02.part02.rar", "d_2024-01-02.part01.rar", "d_2024-01-03.part02.rar", "d_2023-12-31.part01.rar", "readme"]
    rows = discovery.newest(spark.createDataFrame([("m", n) for n in names], "mirror string, name string")).collect()
    assert [tuple(r) for r in rows] == [("m", "2024-01-02", 2)]


def test_api_pages(spark):
    body = '{"5": {"md5": " AB ", "filesize": "12", "pages": -3, "editions": {"a": {"e_id": "10"}, "b": {"e_id": 9}, "c": {"e_id": "x"}}, "add": {"1": {"key": "101", "value": " English "}, "2": {"key": 505, "value": "1-2"}}}}'
    rows = api_pages.records(spark.createDataFrame([(body,), ("[]",)], "body string"))
    r = rows.select("id", api_pages.text(F.col("record"), "md5").alias("md5"), api_pages.number(F.col("record"), "filesize").alias("size"), api_pages.number(F.col("record"), "pages").alias("pages"),
                    api_pages.related_ids(F.col("record"), "editions", "e_id").alias("ids"), api_pages.descriptors(F.col("record"), 101).alias("lang"), api_pages.descriptors(F.col("record"), 505).alias("isbn")).collect()
    assert [tuple(x) for x in r] == [("5", "AB", 12, 0, [9, 10], ["English"], ["1-2"])]


def test_later_rows_of_a_dump_win(spark, tmp_path):
    """Rows are replaced in the order of the dump, however large its files are."""
    from lectern.operators import stage
    from lectern.sources import sqldump

    head = "CREATE TABLE `t` (\n  `id` int,\n  `x` text,\n);\n"
    (tmp_path / "1.sql").write_text(head + "INSERT INTO `t` VALUES (1,'old'),(2,'first'),(2,'second');\n")
    padding = "".join(f"INSERT INTO `t` VALUES ({k},'{'y' * 900}');\n" for k in range(100, 3000))
    (tmp_path / "2.sql").write_text(padding + "INSERT INTO `t` VALUES (1,'new');\n")
    rows = sqldump.read_dump(spark, f"{tmp_path}/*.sql", "t", with_place=True)
    last = {r["id"]: r["x"] for r in stage.last_by_key(rows, ["id"], list(sqldump.PLACE)).where("id in ('1', '2')").collect()}
    assert last == {"1": "new", "2": "second"}
    assert set(sqldump.definitions(spark, f"{tmp_path}/*.sql")) == {"t"}


def test_state_stays_when_a_save_breaks_off(spark, tmp_path):
    """The last state is there until the next has its name; old versions go, the one before the current stays."""
    from lectern.operators.maintain import Store

    store = Store(spark, f"file://{tmp_path}/s")
    for k in range(3):
        store.publish(spark.range(k + 1))
        store.save_state({"k": k})
    assert store.load_state() == {"k": 2} and store.read().count() == 3
    assert len(list((tmp_path / "s").glob("v-*"))) == 2
    (tmp_path / "s" / ".state-1").write_text("{")  # a save that ended before its rename
    assert store.load_state() == {"k": 2}
