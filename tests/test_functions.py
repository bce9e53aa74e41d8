from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "wanted"), [
    ("Élan vital, 42-x", ["elan", "vital", "42", "x"]), ("Straße", ["strasse"]), ("x" * 40 + " ok", ["ok"]), ("x" * 39, ["x" * 39]), ("", []), (None, []), ("...", []),
])
def test_analyze(spark, given, wanted):
    assert value(spark, T.analyze(F.lit(given).cast("string"))) == wanted


def test_relative_path(spark):
    got = T.relative_path(F.lit("The Hobbit: or There/Back?"), F.lit("Tolkien, J.R.R.; Anderson"), F.lit("1937"), F.lit("epub"))
    assert value(spark, got) == "Tolkien, J.R.R/The Hobbit or There Back (1937).epub"
    assert value(spark, T.relative_path(F.lit("..."), F.lit(" ;x"), F.lit("19"), F.lit("pdf"))) == "Unknown Author/Unknown.pdf"


@pytest.mark.parametrize(("n", "wanted"), [(0, ""), (1, "1 B"), (1023, "1023 B"), (1024, "1.0 KB"), (10240, "10 KB"), (1536 * 1024, "1.5 MB"), (5 * 1024**3, "5.0 GB")])
def test_byte_size(spark, n, wanted):
    assert value(spark, T.byte_size(F.lit(n).cast("long"))) == wanted


@pytest.mark.parametrize(("title", "wanted"), [("The Name of the Rose", "NR"), ("an apple", "A"), ("", ""), ("1984", "1"), ("émile zola x", "ÉZ")])
def test_initials(spark, title, wanted):
    assert value(spark, T.initials(F.lit(title))) == wanted


def test_hue(spark):
    h = 0
    for c in "The Hobbit":
        h = (h * 31 + ord(c)) % 2**32
    assert value(spark, T.hue(F.lit("The Hobbit"))) == h % 360


@pytest.mark.parametrize(("code", "name"), [("ENG", "English"), ("deu", "German"), ("xyz", "XYZ"), ("latin", "Latin")])
def test_language_name(spark, code, name):
    assert value(spark, T.language_name(F.lit(code))) == name


def test_encodings(spark):
    assert value(spark, T.percent_encode(F.lit("a b~*é/"))) == "a%20b~%2A%C3%A9%2F"
    assert value(spark, T.header_safe(F.lit('a"é'))) == "a__"
    assert value(spark, T.clean_markers(F.lit("<|x|>"))) == "< |x| >"
    assert value(spark, T.range_key(F.lit("ftp://x"), F.lit(65536).cast("long"))) == hashlib.sha256(b"ftp://x" + (65536).to_bytes(8, "little")).hexdigest()


def test_dates(spark):
    assert value(spark, T.day_text(F.lit(0))) == "1970-01-01"
    assert value(spark, T.day_text(F.lit(20723))) == "2026-09-27"
    assert value(spark, T.day_text(T.day_number(F.to_date(F.lit("2024-02-29"))) + 1)) == "2024-03-01"


def test_isbn_list(spark):
    assert value(spark, T.isbn_list(F.lit("978-1 2||3"))) == ["97812", "3"]
    assert value(spark, T.isbn_list(F.lit(None).cast("string"))) == []


def test_relative_age(spark):
    ages = {None: "never", -5: "just now", 61: "1 min ago", 7300: "2 h ago", 200_000: "2 d ago"}
    for s, wanted in ages.items():
        assert value(spark, T.relative_age(F.lit(s).cast("long"))) == wanted
