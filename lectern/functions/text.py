"""Scalar text functions as column expressions (no Python runs on rows)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of so many bytes or more are dropped before they are folded.
TOKEN_BYTES = 40
_FORBIDDEN = r'[\p{Cntrl}/\\:*?"<>|]'


#: Latin letters, from Latin-1 to the ends of the extended, phonetic and presentation blocks, and digits of other shapes.
_BLOCKS = ((0xAA, 0x24F), (0x250, 0x2AF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2070, 0x209C), (0x2460, 0x24FF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF10, 0xFF5A))
#: Letters whose names don't tell what they fold to.
_OTHERS = {"ß": "ss", "þ": "th", "ð": "d", "ı": "i", "ĸ": "q", "ŋ": "n", "ſ": "s", "ƿ": "w", "ə": "a", "ɛ": "e", "ɔ": "o", "ɑ": "a", "ɩ": "i", "ʃ": "s", "ʒ": "z", "ʊ": "u", "ʋ": "v", "ɣ": "g", "ȸ": "db", "ȹ": "qp", "ỻ": "ll", "ỽ": "v"}
_NAMED = re.compile(r"LATIN SMALL (?:LETTER|LIGATURE) (?:TURNED |REVERSED |OPEN |DOTLESS |SCRIPT |LONG )?([A-Z]{1,2})(?: (?:WITH|PRECEDED BY) .*)?$")


def _plain(c: str) -> str:
    """What a lower-case character folds to; itself if it is no letter or digit of Latin shape."""
    whole = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
    named = _NAMED.match(unicodedata.name(c, ""))
    base = "".join(_OTHERS.get(x) or ((m := _NAMED.match(unicodedata.name(x, ""))) and m[1].lower()) or x for x in whole)
    return _OTHERS.get(c) or next((x for x in (base, named and named[1].lower()) if x and x.isascii() and x.isalnum()), c)


def _tables() -> tuple[str, str, dict[str, str]]:
    """Letters and what each becomes, and those that become several."""
    found = {c: _plain(c) for lo, hi in _BLOCKS for c in map(chr, range(lo, hi + 1)) if c.isalnum() and c.lower() == c and not c.isascii()}
    one = {c: x for c, x in found.items() if len(x) == 1 and x != c}
    return "".join(one), "".join(one.values()), {c: x for c, x in found.items() if len(x) > 1}


_ACCENTED, _PLAIN, _EXPANDED = _tables()
#: A capital with a dot leaves the dot as a mark when it is made small; marks have no counterpart and are removed.
_MARKS = "".join(map(chr, range(0x300, 0x370)))


def fold(token: Column) -> Column:
    low = F.lower(token)
    out = F.translate(low, _ACCENTED + _MARKS, _PLAIN)
    full = out
    for k, v in _EXPANDED.items():
        full = F.replace(full, F.lit(k), F.lit(v))
    expands = out.rlike("[" + "".join(_EXPANDED) + "]")
    return F.when(F.octet_length(low) == F.char_length(low), low).when(expands, full).otherwise(out)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\p{IsAlphabetic}\p{N}]+)"), 1)


def analyze(text: Column) -> Column:
    """Tokens: letters and digits, short enough, lower case, without accents - in this order.

    A text of Latin-1 letters is folded in one piece, which ends no token and joins none; only if it has a token that may be
    too long, or other letters, are its tokens measured and folded one by one."""
    whole = F.coalesce(text, F.lit(""))
    each = F.transform(F.filter(_tokens(whole), lambda t: F.octet_length(t) < TOKEN_BYTES), fold)
    latin = [(a, b) for a, b in zip(_ACCENTED, _PLAIN, strict=True) if a <= "\xff"]
    quick = F.translate(F.lower(whole), "".join(a for a, _ in latin), "".join(b for _, b in latin))
    for k, v in _EXPANDED.items():
        quick = F.replace(quick, F.lit(k), F.lit(v)) if k <= "\xff" else quick
    # folding shortens no token, and one of Latin-1 has two bytes a letter at most
    checked = F.transform(F.array(_tokens(quick)), lambda q: F.when(F.exists(q, lambda t: F.char_length(t) >= TOKEN_BYTES // 2), each).otherwise(q))[0]
    return F.when(whole.rlike(r"[^\x00-\xFF]"), each).otherwise(checked)


def clean(c: Column) -> Column:
    """Text of a dump cell: trimmed, null as empty."""
    return F.coalesce(F.trim(c), F.lit(""))


def isbn(c: Column) -> Column:
    return F.regexp_replace(c, "[- ]", "")


def isbn_list(joined: Column) -> Column:
    """Numbers of a |-joined list without hyphens, spaces and empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(joined, F.lit("")), "[|]"), isbn), lambda x: x != "")


def sanitize(c: Column, longest: int) -> Column:
    """A file name part: forbidden characters as spaces, one space each, no dots or spaces at the ends, cut."""
    one = F.trim(F.regexp_replace(F.regexp_replace(c, _FORBIDDEN, " "), r"\s+", " "))
    cut = F.left(F.regexp_replace(one, r"^[.\s]+|[.\s]+$", ""), F.lit(longest))
    return F.rtrim(F.when(cut == "", "Unknown").otherwise(cut))


def primary_author(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, "^[^;&]*", 0))


def relative_path(title: Column, author: Column, year: Column, extension: Column) -> Column:
    first = primary_author(author)
    digits = F.left(F.regexp_replace(year, "[^0-9]", ""), F.lit(4))
    name = sanitize(title, 150)
    return F.concat(
        sanitize(F.when(first == "", "Unknown Author").otherwise(first), 100), F.lit("/"),
        F.when(F.length(digits) == 4, F.concat(name, F.lit(" ("), digits, F.lit(")"))).otherwise(name), F.lit("."), sanitize(extension, 10))


def download_name(title: Column, author: Column, extension: Column) -> Column:
    first = primary_author(author)
    return F.concat(sanitize(F.when(first == "", title).otherwise(F.concat(first, F.lit(" - "), title)), 180), F.lit("."), extension)


def percent_encode(c: Column) -> Column:
    """UTF-8 percent encoding that keeps letters, digits and -._~ only."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def header_safe(c: Column) -> Column:
    return F.regexp_replace(c, r'[^\x00-\x7F]|"', "_")


def clean_markers(c: Column) -> Column:
    """Prompt markers of a model are broken up."""
    return F.replace(F.replace(c, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def describe(title: Column, author: Column) -> Column:
    return F.concat(F.left(title, F.lit(160)), F.lit(" by "), F.left(author, F.lit(160)))


def first_words(c: Column, n: int = 4) -> Column:
    return F.array_join(F.slice(F.split(F.trim(c), r"\s+"), 1, n), " ")


def page_link(page: Column, pattern: str) -> Column:
    """First group of a pattern in a page, with its ampersands decoded."""
    return F.replace(F.regexp_extract(page, pattern, 1), F.lit("&amp;"), F.lit("&"))


def byte_size(n: Column, gigabytes: bool = True) -> Column:
    """A size with its unit, nothing for none. gigabytes: whether large sizes are shown in GB, or in MB however large they are."""
    out = F.lit("")
    kb, mb, gb = 1024, 1024**2, 1024**3

    def shown(x: Column, unit: str) -> Column:
        tenth = F.floor(x * 10 + 0.5) / 10
        return F.concat(F.when(x < 10, F.format_string("%.1f", tenth)).otherwise(F.floor(x + 0.5).cast("string")), F.lit(f" {unit}"))

    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, out).when(n < kb, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < mb, shown(n / kb, "KB")).when((n < gb) | F.lit(not gigabytes), shown(n / mb, "MB")).otherwise(shown(n / gb, "GB")))


def relative_age(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0))
    return (
        F.when(seconds.isNull(), "never").when(s < 60, "just now").when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit(" h ago"))).otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit(" d ago"))))


def initials(title: Column) -> Column:
    words = F.filter(F.split(title, r"\s+"), lambda w: w.rlike(r"^[\p{L}\d]") & ~w.rlike("(?i)^(the|a|an|of|and|le|la|der|die|das)$"))
    return F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.upper(F.left(w, F.lit(1)))), "")


def hue(seed: Column) -> Column:
    """h * 31 + c modulo 2 ** 32 over the characters, then modulo 360."""
    codes = F.transform(F.filter(F.split(seed, ""), lambda c: c != ""), lambda c: F.expr("0L") + F.ascii(c))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32), lambda h: h % 360)


#: Language names and their codes.
LANGUAGES = {
    "English": ("eng",), "German": ("ger", "deu"), "French": ("fre", "fra"), "Spanish": ("spa",), "Italian": ("ita",), "Portuguese": ("por",), "Russian": ("rus",),
    "Czech": ("cze", "ces"), "Polish": ("pol",), "Dutch": ("dut", "nld"), "Chinese": ("chi", "zho"), "Japanese": ("jpn",), "Hebrew": ("heb",),
}


def language_name(code: Column) -> Column:
    c = F.lower(code)
    out = F.when(F.length(c) == 3, F.upper(c)).otherwise(F.initcap(c))
    for name, codes in LANGUAGES.items():
        out = F.when(c.isin(*codes), name).otherwise(out)
    return out


def day_number(date: Column) -> Column:
    return F.unix_date(date)


def day_text(days: Column) -> Column:
    return F.date_format(F.date_from_unix_date(days), "yyyy-MM-dd")


def range_key(url: Column, offset: Column) -> Column:
    """SHA-256 of an address and a little-endian 64-bit offset."""
    little = F.reverse(F.lpad(F.hex(offset), 16, "0"))
    pairs = F.regexp_replace(little, "(.)(.)", "$2$1")
    return F.sha2(F.concat(F.encode(url, "UTF-8"), F.unhex(pairs)), 256)
