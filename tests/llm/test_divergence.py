"""The distances and verdicts of the quality rules against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_corpus import WORD, brute

from lectern.llm import kernel, quality

DOC = "doc_id long, text string, lang string"


def kind(c):
    for k, pattern in enumerate((r"[a-z]", r"[A-Z]", r"[0-9]", r" ", r"\n", r"[.,;:!?'\"()-]", r"[#*$%&|<>]")):
        if re.fullmatch(pattern, c):
            return k
    return 7 if c.isascii() else 8


def jsd(p, q):
    keys = {*p, *q}
    part = lambda a, b: sum(a[k] * math.log2(2 * a[k] / (a[k] + b[k])) for k in keys if a[k])
    return math.sqrt(max(0, (part(p, q) + part(q, p)) / 2))


def shares(counts):
    total = sum(counts.values())
    return Counter({k: n / total for k, n in counts.items()})


def words_of(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in WORD.findall(text)]


def bucket(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(quality.word_buckets(data, np.array([0, len(data)]))[0][0])


def verdicts(rows):
    chars, words = {}, {}
    for _, text, lang in rows:
        for key in {lang, "*"} - {None}:
            chars.setdefault(key, Counter()).update(map(kind, text or ""))
            words.setdefault(key, Counter()).update(words_of(text or ""))
    all_chars, all_words = shares(chars["*"]), shares(words["*"])
    refs = {}
    for key in chars:
        c = Counter({k: n + quality.LENT_CHARS * all_chars[k] for k, n in (chars[key] + Counter({k: 0 for k in all_chars})).items()})
        for k in all_chars:
            c[k] = chars[key][k] + quality.LENT_CHARS * all_chars[k]
        common = dict(sorted(words[key].items(), key=lambda wn: (-wn[1], bucket(wn[0])))[: quality.COMMON])
        n = Counter({w: k + quality.LENT_WORDS * all_words[w] for w, k in common.items()})
        n["else", "where"] = sum(words[key].values()) - sum(common.values()) + quality.LENT_WORDS * (1 - sum(all_words[w] for w in common))
        refs[key] = shares(c), shares(n), set(common)
    out = {}
    for i, text, lang in rows:
        text = text or ""
        n, n_chars, *_, repeated = brute(text)
        found = []
        for key in [lang] if lang is not None else refs:
            ref_chars, ref_words, common = refs[key]
            own = Counter(w if w in common else ("else", "where") for w in words_of(text))
            found.append((jsd(shares(Counter(map(kind, text))), ref_chars) if text else 0.0, jsd(shares(own), ref_words) if own else 0.0))
        a, b = min(found, key=lambda f: max(f[0] / quality.CHAR_LIMIT, f[1] / quality.WORD_LIMIT))
        kept = n >= 50 and 100 * repeated <= 50 * n and (n_chars < quality.LEAST_CHARS or a <= quality.CHAR_LIMIT) and (n < quality.LEAST_WORDS or b <= quality.WORD_LIMIT)
        out[i] = a, b, kept
    return out


def test_distances_and_verdicts(spark):
    rng = random.Random(2)
    vocabulary = {"en": "the of and stone river light house green walk".split(), "": "una el la piedra río luz casa verde".split(), "xx": "да нет камень река свет дом".split()}
    rows = []
    for i in range(240):
        lang = rng.choice([*vocabulary, None])
        source = vocabulary[lang if lang is not None else rng.choice([*vocabulary])]
        w = [rng.choices(source, [2.0**-k for k in range(len(source))])[0] + rng.choice(["", "", ",", "."]) for _ in range(rng.choice([0, 3, 49, 55, 59, 60, 90, 200]))]
        style = rng.random()
        w = [x.upper() + "!!" for x in w] if style < 0.1 else [x + "%%%" for x in w] if style < 0.2 else [f"q{rng.randrange(99)}" for _ in w] if style < 0.3 else ["a"] * len(w) if style < 0.35 else w
        rows.append((i, rng.choice([" ", " ", "\n"]).join(w), lang))
    rows += [(900, None, "en"), (901, "z " * 60, "rare"), (902, " ".join(f"b{k}" for k in range(55)), "en"), (903, " ".join(f"{k % 10}x" for k in range(58)), "en")]
    want = verdicts(rows)
    got = {r["doc_id"]: r for r in quality.op9(spark.createDataFrame(rows, DOC)).collect()}
    assert len(got) == len(want)
    for i, (a, b, kept) in want.items():
        assert (got[i]["char_distance"], got[i]["word_distance"]) == (pytest.approx(a, abs=1e-9), pytest.approx(b, abs=1e-9)), rows[i] if i < 900 else i
        assert got[i]["kept"] == kept
    assert {k for *_, k in want.values()} == {True, False}


def test_lengths_below_the_guards(spark):
    good = "the of and stone river light house green walk tree"
    rng = random.Random(1)
    text = lambda n, words: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(120, good.split()), "en") for i in range(60)]
    odd = [f"{a}{b}{c}" for a in "bcd" for b in "aei" for c in "lmnpr"]
    rows += [(100, " ".join(rng.sample(odd * 2, 59)), "en"), (101, " ".join(rng.sample(odd * 2, 60)), "en")]
    got = {r["doc_id"]: r for r in quality.op9(spark.createDataFrame(rows, DOC)).collect()}
    assert got[100]["word_distance"] > quality.WORD_LIMIT and got[101]["word_distance"] > quality.WORD_LIMIT
    assert got[100]["kept"] and not got[101]["kept"]


def test_sums_are_sent_on_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} w{i % 7} and", "en" if i % 3 else None) for i in range(300)], DOC)
    whole = quality.references(docs)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"] * 50, "text": [f"w{i}" for i in range(100)]})
    monkeypatch.setattr(kernel, "HELD", 10)
    parts = list(quality._histograms(iter([batch, batch])))
    assert len(parts) > 1 and sum(p.column("n").to_pylist()[k] for p in parts for k in range(p.num_rows) if p.column("slot").to_pylist()[k] >= quality.CLASSES) == 200
    assert set(whole) == {None, "en"}
    with pytest.raises(ValueError):
        monkeypatch.setattr(quality, "LANGUAGES", 0)
        quality.references(docs)
