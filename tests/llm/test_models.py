"""The models' scoring against plain Python: naive Bayes over n-grams, random-indexing vectors and pooling, licence predictions on planted paragraphs."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleweft.llm import language, licenses, quality_model

MASK = (1 << 64) - 1


def plain_grams(text, buckets):
    """Buckets of the n-grams of a text, one by one."""
    low = "  " + (text or "").lower() + "  "
    c = [ord(x) if x.isalpha() else 32 for x in low]
    a, b, d = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    place = lambda h: (h * a & MASK) >> 40
    out = Counter()
    for i, x in enumerate(c):
        out[place(x) % buckets] += x != 32
        if i + 1 < len(c):
            out[place((x * b + c[i + 1]) & MASK) % buckets] += x != 32 or c[i + 1] != 32
        if i + 2 < len(c):
            out[place(((x * d + c[i + 1]) * b + c[i + 2]) & MASK) % buckets] += c[i + 1] != 32
    return +out


TEXTS = ["the cat sat", "le chat dort", "", None, "12 34 !", "Straße über", "a", "the end of the day", "la fin du jour", "ﬁn İstanbul", "x" * 300, "the the the"]


def test_ngrams_of_a_text_are_its_own():
    """Whatever texts stand beside it."""
    texts = [t or "" for t in TEXTS]
    for order in (texts, texts[::-1], texts[3:] + texts[:3]):
        counts, ids, has = language.grams(order, 997)
        at = 0
        for t, n, letter in zip(order, counts, has):
            assert Counter(ids[at : at + n].tolist()) == plain_grams(t, 997)
            assert letter == any(x.isalpha() for x in t.lower())
            at += n


def test_naive_bayes(spark):
    langs = ["en", "fr", "de", "en", "en", "de", "en", "en", "fr", "de", None, "fr"]
    rows = [(i, t, x) for i, (t, x) in enumerate(zip(TEXTS, langs))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    names, table = language.learn(docs.where("lang IS NOT NULL AND text IS NOT NULL"), buckets=211)
    known = [(t, x) for _, t, x in rows if x and t is not None]
    assert names == ["de", "en", "fr"]
    counts = {x: sum((plain_grams(t, 211) for t, y in known if y == x), Counter()) for x in names}
    chance = {x: [math.log((counts[x][k] + 0.5) / (sum(counts[x].values()) + 0.5 * 211)) for k in range(211)] for x in names}
    prior = {x: math.log(sum(y == x for _, y in known) / len(known)) for x in names}
    got = {r.doc_id: r for r in language.predict(docs.withColumn("held_out", F.lit(False)), (names, table)).collect()}
    for i, t, _ in rows:
        found = plain_grams(t, 211)
        if not any(x.isalpha() for x in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        n = sum(found.values())
        z = {x: (sum(chance[x][k] * c for k, c in found.items()) + prior[x]) / math.sqrt(n) for x in names}
        p = {x: math.exp(z[x] - max(z.values())) for x in names}
        assert got[i].lang_pred == max(sorted(p), key=p.get)
        assert got[i].score == pytest.approx(max(p.values()) / sum(p.values()), rel=1e-4)


def test_languages_that_tie(spark):
    docs = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a")], "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert {r.lang_pred for r in language.predict(docs.withColumn("held_out", F.lit(False)), model).collect()} == {"a"}


def test_word_vectors_and_pooling(spark):
    buckets, size = 64, 8
    texts = ["the cat sat on the mat", "The mat, 12 cats!", "", None, "a_b c", "cat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sums, counts = quality_model.word_vectors(docs, buckets, size, 5)
    index = quality_model.index_vectors(buckets, size, 5)[:-1].astype(int)
    ids = [[zlib.crc32(w.encode()) % buckets for w in quality_model.TOKEN.findall((t or "").lower())] for t in texts]
    want, often = np.zeros((buckets, size), int), np.zeros(buckets, int)
    for found in ids:
        for i, w in enumerate(found):
            often[w] += 1
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(found):
                    want[w] += index[found[j]]
    assert (sums == want).all() and (counts == often).all()
    share = counts / counts.sum()
    unit = np.array([v / max(math.sqrt(sum(x * x for x in v)), 1e-9) for v in want.astype(float)])
    unit = unit - share @ unit
    unit = np.array([v / max(math.sqrt(sum(x * x for x in v)), 1e-9) for v in unit])
    got = {r.doc_id: np.frombuffer(r.vec, np.float32) for r in quality_model.pooled(docs, sums, counts).collect()}
    for i, found in enumerate(ids):
        if not found:
            assert not got[i].any()
            continue
        w = [1e-3 / (1e-3 + share[k]) for k in found]
        mean = sum(x * unit[k] for x, k in zip(w, found)) / sum(w)
        square = sum(x * unit[k] ** 2 for x, k in zip(w, found)) / sum(w)
        both = sum((unit[a] * unit[b] for a, b in zip(found, found[1:])), np.zeros(size)) / len(found)
        assert np.allclose(got[i], np.concatenate((mean, square, both)), atol=1e-5)


def test_network_scores():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 6))
    net = quality_model.Network(x, (x[:, 0] + 0.1 * rng.normal(size=6000) > 0).astype(float), hidden=5)
    for row, score in zip(x[:20], net.score(x[:20])):
        h = [max(0.0, sum((row[i] - net.mean[i]) / net.spread[i] * net.w[0][i, k] for i in range(6)) + net.w[1][k]) for k in range(5)]
        z = (sum(h[k] * net.w[2][k, 0] for k in range(5)) + net.w[3][0]) / net.temperature
        assert score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)
    right = (net.score(x) >= 0.5) == (x[:, 0] > 0)
    assert right.mean() > 0.9


def test_several_labels_and_texts_of_one_document(spark):
    """The least label counts, whatever order rows come in."""
    docs = [(i, f"good words here {i}" if i % 2 else f"bad stuff there {i}") for i in range(60)] + [(3, "another text of it")]
    labels = [(i, i % 2) for i in range(60)] + [(i, 1 - i % 2) for i in range(0, 60, 5)]
    runs = []
    for k in (1, 5):
        d = spark.createDataFrame(docs[::-1] if k == 1 else docs, "doc_id long, text string").repartition(k)
        lab = spark.createDataFrame(labels[::-1] if k == 1 else labels, "doc_id long, quality int").repartition(k)
        runs.append(sorted((r.doc_id, round(r.score, 6)) for r in quality_model.classify(d, lab, buckets=256, size=8).collect()))
    assert runs[0] == runs[1]


def test_planted_licences(spark):
    """Precision and recall over planted lines: every stated sentence between lines of prose, and prose alone that talks of licences."""
    prose = ["The river ran past the old mill.", "A licence to fish was sold at the gate.", "She read the terms of the contract twice.", "Version two of the play was better received."]
    rows, want = [], set()
    for family, sentences in licenses.TEMPLATES.items():
        for k, text in enumerate(sentences):
            i = len(rows)
            rows.append((i, "\n".join([prose[i % 4], text, prose[(i + 1) % 4]])))
            want.add((i, 1, family))
    rows += [(1000 + i, prose[i % 4]) for i in range(40)]
    got = {(r.doc_id, r.paragraph, r.family) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("confirmed").collect()}
    hit = len(got & want)
    assert hit / len(got) >= 0.95 and hit / len(want) >= 0.95, (len(got), len(want), sorted(got - want)[:5], sorted(want - got)[:5])
