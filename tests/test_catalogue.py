from __future__ import annotations

import datetime
import json
import struct

import pytest

from lectern.catalogue import COLUMNS, Catalogue
from lectern.sources import binary, sqldump
from test_sources import block, definition

MD5 = [c * 32 for c in "abcdef"]


PREFIX = "shop_"
OWN = {"topic": f"{PREFIX}topic", "main_id": f"{PREFIX}id"}


def dump(spark, path):
    tables = {
        "editions": [("1", "f", "", "The Native Archive", "Test Author", "Series", "Publisher", "2026"), ("2", "l", "", "Über den Wald", "Müller; Kant", "", "", "1999"), ("3", "a", "", "Article", "X", "", "", ""), ("4", "f", "no", "Hidden", "X", "", "", "")],
        "editions_add_descr": [("1", "1", "101", "English"), ("2", "1", "505", "978-1 2"), ("3", "2", "101", "German"), ("4", "1", "305", "note")],
        "editions_to_files": [("10", "1"), ("11", "2"), ("12", "3"), ("13", "4"), ("14", "1")],
        "files": [("10", "0", "77", "f", "epub", "", "N", MD5[0], "12345", "321"), ("11", "5", "0", "l", "PDF", "", "N", MD5[1].upper(), "9", "9"), ("12", "0", "0", "a", "pdf", "", "N", MD5[2], "9", "9"), ("13", "0", "0", "f", "epub", "", "N", MD5[3], "9", "9"), ("14", "0", "90", "f", "epub", "", "Y", MD5[4], "9", "9")],
    }
    for i, (name, rows) in enumerate(tables.items()):
        sqldump.write_dump(spark.createDataFrame(rows, ", ".join(f"{OWN.get(c, c)} string" for c in COLUMNS[name])), name, f"{path}/{i}", 2)
    return f"{path}/*"


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("catalogue")
    c = Catalogue(spark, f"file://{path}/store")
    c.import_dump(dump(spark, path / "dump"), "main", PREFIX)
    return c


def test_import(catalogue):
    rows = {r["md5"]: r for r in catalogue.books().collect()}
    assert set(rows) == {MD5[0], MD5[1]}
    assert (rows[MD5[0]]["language"], rows[MD5[0]]["isbn"], rows[MD5[0]]["filesize"]) == ("english", ["97812"], 12345)
    assert catalogue.status()["next_file_ids"] == {"f": 91, "l": 6}


def test_search(catalogue):
    found = lambda *a, **k: [r["md5"] for r in catalogue.search(*a, **k).collect()]
    assert found("native archive") == [MD5[0]] and found("nativ archive") == [MD5[0]] and found("wald nothing") == [MD5[1]]
    assert found("uber wald") == [MD5[1]] and found("97812") == [MD5[0]] and found("wald", lang="english") == []
    assert sorted(found("*")) == [MD5[0], MD5[1]] and found("*", ext="PDF, ") == [MD5[1]]
    assert catalogue.contains(MD5[1].upper()) and not catalogue.contains("f" * 32)
    assert all(catalogue.verify().values()) and catalogue.health()["ok"]
    with pytest.raises(ValueError, match="empty"):
        catalogue.search("  ")


def test_refresh(spark, tmp_path):
    c = Catalogue(spark, f"file://{tmp_path}/store")
    c.import_dump(dump(spark, tmp_path / "dump"), "main", PREFIX)
    file = lambda md5, **k: {"md5": md5, "extension": "epub", "visible": "", "broken": "", f"{PREFIX}topic": "f", "filesize": "5", "pages": 1} | k
    files = {
        "1": file(MD5[0]), "2": file(MD5[1], broken="Y"), "3": file(MD5[2], editions={"a": {"e_id": "100"}, "b": {"e_id": "20"}, "c": {"e_id": 9}}),
        "4": file(MD5[3], editions={"a": {"e_id": "9"}}), "5": file(MD5[4], shop_topic="m"), "6": file("short"),
    }
    editions = {"9": {"title": "T", "visible": "no"}, "20": {"title": "Twenty", "visible": "", "add": {"1": {"key": "101", "value": "Dutch"}}}, "100": {"title": "Hundred", "visible": ""}}
    page = lambda x: spark.createDataFrame([(json.dumps(x),), ("[]",)], "body string")
    for _ in range(2):
        c.refresh(page(files), page(editions), {"f": "main"}, datetime.date(2024, 5, 9), PREFIX)
        got = {r["md5"]: r for r in c.books().collect()}
        assert set(got) == {MD5[0], MD5[2]} and got[MD5[2]]["title"] == "Twenty" and got[MD5[2]]["language"] == "dutch" and got[MD5[0]]["filesize"] == 12345
    assert [d.day for d in c.days_due(datetime.date(2024, 5, 10))] == [9, 10]
    assert len(c.days_due(datetime.date(2024, 7, 1))) == 8


#: Columns that are numbers, and the width of the others.
NUMBERS, WIDE = {"e_id", "e_add_id", "key", "f_id", f"{PREFIX}id", "fiction_id", "filesize", "pages"}, 40


def binary_tables(folder, tables: dict[str, list[tuple]], less: int = 0) -> None:
    """The tables as three files each: two with fixed records, the others with packed ones, long values in three blocks."""
    for name, rows in tables.items():
        columns = [OWN.get(c, c) for c in COLUMNS[name]]
        linked = name in ("editions", "editions_add_descr")
        kinds = [(c, 8, 8, 0) if c in NUMBERS else (c, 10, 252, 0) if c == "value" else (c, WIDE + 1, 15, 0) if linked else (c, WIDE, 254, 0) for c in columns]
        fields = [(0, 1, 0, 0)] + [((3 if linked else 0), 8, 0, 0) if c in NUMBERS else (4, 10, 1, 0) if c == "value" else ((8 if linked else 0), w, 0, 0) for c, w, *_ in kinds]
        width, bitmap = sum(f[1] for f in fields), -(-sum(f[0] in (3, 4) for f in fields) // 8)
        base, size = 40, 100
        head = bytearray(base + size) + b"".join(struct.pack(">hHBH", *f) for f in fields)
        head[:4] = b"\xfe\xfe\x07\x01"
        for form, at, value in ((">H", 4, int(linked)), (">H", 6, len(head)), (">H", 10, size), (">H", 12, base), (">Q", 28, len(rows) - less), (">I", base + 44, width), (">I", base + 64, len(fields)), (">H", base + 76, bitmap)):
            struct.pack_into(form, head, at, value)
        data = b""
        for row in rows:
            if not linked:
                data += b"\1" + b"".join(int(v).to_bytes(8, "little") if c in NUMBERS else v.encode().ljust(WIDE) for c, v in zip(columns, row, strict=True))
                continue
            null = any(v is None for v in row)
            record = bytes(bitmap) + bytes([null])
            for c, v in zip(columns, row, strict=True):
                text = (v or "").encode()
                record += int(v).to_bytes(8, "little") if c in NUMBERS else len(text).to_bytes(2, "little") + text if c == "value" else bytes([len(text)]) + text
            if len(record) < 60:
                data += block(3, record)
            else:
                data += block(13, record[:20], len(record)) + block(12, record[20:40]) + block(8, record[40:])
        (folder / f"{name}.frm").write_bytes(definition(kinds))
        (folder / f"{name}.MYI").write_bytes(bytes(head) + b"keys" * 10)
        (folder / f"{name}.MYD").write_bytes(data)


TABLES = {
    "editions": [("1", "f", "", "The Native Archive", "Test Author", "Series", "Publisher", "2026"), ("2", "l", "", "Über den Wald", "Müller; Kant", "", "", "1999"), ("3", "a", "", "Article", "X", "", "", "")],
    "editions_add_descr": [("1", "1", "101", "English"), ("2", "1", "505", "978-1 2"), ("3", "2", "101", "x" * 65), ("4", "2", "101", None), ("5", "2", "101", "German"), ("6", "2", "305", "long note " * 30)],
    "editions_to_files": [("10", "1"), ("11", "2"), ("12", "3")],
    "files": [("10", "0", "77", "f", "epub", "", "N", MD5[0], "12345", "321"), ("11", "5", "0", "l", "PDF", "", "N", MD5[1].upper(), "9", "9"), ("12", "0", "0", "a", "pdf", "", "N", MD5[2], "9", "9")],
}


def test_binary_import(spark, tmp_path):
    c = Catalogue(spark, f"file://{tmp_path}/store")
    good, corrupt = tmp_path / "good", tmp_path / "corrupt"
    good.mkdir(), corrupt.mkdir()
    binary_tables(good, TABLES)
    c.import_binary(f"file://{good}", "main", PREFIX)
    rows = {r["md5"]: r for r in c.books().collect()}
    assert {m: (r["title"], r["language"], r["isbn"], r["filesize"]) for m, r in rows.items()} == {MD5[0]: ("The Native Archive", "english", ["97812"], 12345), MD5[1]: ("Über den Wald", "german", [], 9)}
    assert c.status()["next_file_ids"] == {"f": 78, "l": 6}
    assert [r["md5"] for r in c.search("nativ archive").collect()] == [MD5[0]]
    # a table with more rows than its index says leaves everything as it was
    binary_tables(corrupt, TABLES | {"editions": TABLES["editions"] + [("4", "f", "", "Other", "Y", "", "", "")]}, less=1)
    with pytest.raises(binary.TableError, match="rows where the header says"):
        c.import_binary(f"file://{corrupt}", "main", PREFIX)
    (corrupt / "files.MYD").unlink()
    with pytest.raises(binary.TableError):
        c.import_binary(f"file://{corrupt}", "main", PREFIX)
    assert {r["md5"] for r in c.books().collect()} == set(rows) and [r["md5"] for r in c.search("archive").collect()] == [MD5[0]]


def test_an_index_that_was_left_behind_is_caught_up(spark, tmp_path):
    c = Catalogue(spark, f"file://{tmp_path}/store")
    good = tmp_path / "good"
    good.mkdir()
    binary_tables(good, TABLES)
    c.import_binary(f"file://{good}", "main", PREFIX)
    # the books change, and the writer ends before the index does
    c.store.change(spark.createDataFrame([(MD5[0],)], "md5 string"), c.books().limit(0))
    assert c.search("archive").collect() == [] and c.status()["documents"] == 1
