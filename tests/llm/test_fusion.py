"""Fused posteriors and the ordinal regression against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.llm import langid, toxicity
from lectern.llm.kernel import LOWER


def trigram_counts(text):
    low = bytes(LOWER[np.frombuffer((text or "").encode(), np.uint8)])
    return Counter(((low[k] * 65536 + low[k + 1] * 256 + low[k + 2]) * 0x9E3779B1 >> 11) % langid.BUCKETS for k in range(len(low) - 2))


def normal(logs):
    p = [math.exp(x - max(logs)) for x in logs]
    return [x / sum(p) for x in p]


def brute(docs, rows):
    """rows: (table, id, host, domain, declared, suffix, text)."""
    counts = defaultdict(Counter)
    for text, lang in docs:
        counts[lang].update(trigram_counts(text))
    langs = sorted(counts)
    size = {x: sum(counts[x].values()) + 0.5 * langid.BUCKETS for x in langs}
    lls, soft = [], []
    for *_, text in rows:
        c = trigram_counts(text)
        total = sum(c.values())
        scale = langid.TEMPER * min(1, langid.ENOUGH / max(1, total))
        lls.append([scale * sum(n * math.log((counts[x][b] + 0.5) / size[x]) for b, n in c.items()) for x in langs])
        soft.append(normal(lls[-1]))
    n = len(langs)
    level = lambda picks: [sum(soft[i][k] for i in picks) for k in range(n)]
    smooth = lambda s, q: [(s[k] + langid.LENT * q[k]) / (sum(s) + langid.LENT) for k in range(n)]
    out = {}
    for i, (table, id_, host, domain, declared, suffix, _) in enumerate(rows):
        of = [k for k, r in enumerate(rows) if r[0] == table]
        every = smooth(level(of), [1 / n] * n)
        by_domain = smooth(level([k for k in of if (rows[k][3] or "") == (domain or "")]), every)
        prior = smooth(level([k for k in of if (rows[k][3] or "", rows[k][2] or "") == (domain or "", host or "")]), by_domain)
        t = level(of)
        known = lambda x: x if x in langs else ""
        d = level([k for k in of if known(rows[k][4]) == known(declared)])
        same = [k for k in of if (rows[k][5] or "") == (suffix or "")]
        s = level(same)
        logs = [
            lls[i][k] + math.log(prior[k]) + math.log((d[k] + 0.5 + (langid.AGREE if known(declared) == x else 0)) / (t[k] + langid.AGREE + 0.5 * (n + 1)))
            + math.log((s[k] + (langid.AGREE if suffix == x else 0) + len(same) / len(of)) / (t[k] + langid.AGREE + 1)) for k, x in enumerate(langs)]
        post = normal(logs)
        out[table, id_] = langs[post.index(max(post))], max(post)
    return out


def test_fused_posteriors(spark):
    rng = random.Random(5)
    words = {"de": "und der das haus licht fluss".split(), "en": "and the that house light river".split(), "fr": "et le la maison rivière lumière".split()}
    docs = [(" ".join(rng.choices(words[x], k=30)), x) for x in words for _ in range(8)]
    rows = []
    for i in range(80):
        lang = rng.choice([*words])
        text = " ".join(rng.choices(words[lang], k=rng.choice([0, 1, 2, 30, 900])))
        host = rng.choice(["a.x.de", "b.x.de", "c.y.com", "d.y.com", None])
        rows.append((rng.choice(["documents", "pages"]), i, host, host and host[2:], rng.choice(["", lang, "en", "xx", None]), rng.choice([host and host[4:], lang, None]), rng.choice([text, text, text, None])))
    model = langid.text_model(spark.createDataFrame(docs, "text string, lang string"))
    table = spark.createDataFrame(rows, "table string, id long, host string, domain string, declared string, suffix string, text string")
    got = {(r["table"], r["id"]): r for r in langid.identify(table, model).collect()}
    want = brute(docs, rows)
    assert len(got) == len(want)
    for key, (lang, confidence) in want.items():
        assert got[key]["confidence"] == pytest.approx(confidence, rel=1e-9), key
        assert got[key]["lang"] == lang


def test_suffixes_are_learned(spark):
    """A top level domain that is no language's name speaks for the language that is found there."""
    texts = {"de": "und der das haus licht fluss nicht", "en": "and the that house light river not"}
    model = langid.text_model(spark.createDataFrame([(t * 9, x) for x, t in texts.items()], "text string, lang string"))
    rows = [(i, f"http://h{i}.example.zz/p", texts["de"] * 5) for i in range(30)] + [(100 + i, f"http://h{i}.other.qq/p", texts["en"] * 5) for i in range(30)]
    rows += [(200, "http://new.place.zz/p", ""), (201, "http://new.spot.qq/p", "")]
    got = {r["id"]: r["lang"] for r in langid.identify(langid.page_evidence(spark.createDataFrame(rows, "page_id string, url string, html string")), model).collect()}
    assert (got[200], got[201]) == ("de", "en")


@pytest.mark.parametrize("grades", [1, 2, 3])
def test_gradient_of_the_ordinal_regression(grades):
    rng = np.random.default_rng(grades)
    model = toxicity.Model(np.arange(1, 6, dtype=np.uint64) << np.uint64(50), grades)
    grade = rng.integers(0, grades + 1, 40)
    text, feature = np.nonzero(rng.random((40, 5)) < 0.4)
    p = model.parameters() + rng.normal(0, 0.5, len(model.parameters()))
    model.assume(p)
    value, slope = model.objective(feature, text, grade)
    # the likelihood, written out
    direct = 0.0
    for i in range(40):
        score = model.weights[feature[text == i]].sum()
        reach = [1.0, *(1 / (1 + math.exp(t - score)) for t in model.thresholds), 0.0]
        direct += math.log(reach[grade[i]] - reach[grade[i] + 1])
    assert value == pytest.approx(direct / 40 - toxicity.SHRINK * (model.weights**2).sum() / 2)
    for k in range(len(p)):
        step = np.zeros(len(p))
        step[k] = 1e-6
        model.assume(p + step)
        up, _ = model.objective(feature, text, grade)
        model.assume(p - step)
        down, _ = model.objective(feature, text, grade)
        assert slope[k] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_scores_against_brute_force(spark):
    """Every text's expected severity from its words and their beginnings, one by one."""
    import re

    rng = random.Random(9)
    mild, bad, clean = "grumble pest".split(), "scoundrel villain".split(), "garden river lamp stone window thanks".split()
    rows, labels = [], []
    for i in range(300):
        grade = rng.choice([0, 0, 1, 2])
        w = rng.choices(clean, k=12) + rng.choices(mild, k=2 * (grade > 0)) + rng.choices(bad, k=2 * (grade > 1)) + ["gratitude"] * (not grade)
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, grade))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(0, None), (1, -3)], "doc_id long, toxic int")
    model = toxicity.trained(docs, marks)
    assert len(model.thresholds) == 2
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))

    def hashes(word):
        from lectern.llm.kernel import Texts

        data = np.frombuffer(word.encode(), np.uint8)
        return toxicity._all_features(Texts(data, np.array([0, len(data)]), lower=True))[0].tolist()

    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks).collect()}
    for (i, text), (_, grade) in zip(rows, labels, strict=True):
        seen = {h for w in re.findall("[a-z]+", text) for h in hashes(w)}
        score = sum(weight.get(h, 0.0) for h in seen)
        want = sum(1 / (1 + math.exp(t - score)) for t in model.thresholds)
        assert got[i]["expected_severity"] == pytest.approx(want, abs=1e-6) and abs(want - grade) < 0.5 and got[i]["toxic"] == (grade > 0)
    # evidence of clean texts takes part too
    assert (model.weights < 0).any() and (model.weights > 0).any()


def test_only_the_order_of_grades_counts(spark):
    """A stray label of a million is one grade more, not a million; too many grades are an error."""
    rng = random.Random(4)
    rows = []
    for i in range(240):
        grade = i % 3
        rows.append((i, " ".join(rng.choices("garden river lamp stone".split(), k=12) + ["", "grumble pest", "scoundrel villain"][grade].split()), grade))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = []
    for names in ((0, 1, 2), (0, 7, 1_000_000)):
        marks = spark.createDataFrame([(r[0], names[r[2]]) for r in rows], "doc_id long, toxic int")
        found.append({r["doc_id"]: r["expected_severity"] for r in toxicity.toxicity(docs, marks).collect()})
    assert found[0] == pytest.approx(found[1]) and all(abs(found[0][r[0]] - r[2]) < 0.5 for r in rows)
    many = spark.createDataFrame([(k, k) for k in range(toxicity.GRADES + 2)], "doc_id long, toxic int")
    with pytest.raises(ValueError, match="grades"):
        toxicity.trained(docs, many)


def test_grades_come_from_other_texts(spark):
    """Severe texts are those with more toxic sentences; words of the text's own fold don't count."""
    rows = []
    for i in range(200):
        toxic = i % 2
        sentences = [f"the garden path{i}"] * 6
        for k in range((1 if i % 4 == 1 else 4) * toxic):
            sentences[k] = "you scoundrel there"
        rows.append((i, toxic, ". ".join(sentences) + "."))
    texts = spark.createDataFrame(rows, "key long, toxic long, text string")
    got = {r["key"]: r["grade"] for r in toxicity.graded(texts).collect()}
    assert got == {i: 1 if i % 4 == 1 else 2 for i in range(200) if i % 2}
    alone = spark.createDataFrame([(1, 1, "unheard of. unheard of. unheard of. unheard of"), (2, 0, "fine")], "key long, toxic long, text string")
    assert [r["grade"] for r in toxicity.graded(alone).collect()] == [1]
