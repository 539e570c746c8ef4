"""Scores of the field and of the regression against plain loops, n-gram by n-gram and word by word."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from farsight.llm import language, toxicity

TEXTS = [
    "You are a damned fool, go away!", "the cat sat on the mat", "", None, "  \n", "12 !?", "Straße häuser über den see, und die katze", "a", "fool " * 150 + "the cat", "x" * 5000,
    "Le chat est là; été, où?", "日本語 text", "damned. damned! (damned) THE",
]


def plain_toxicity(text, field):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    edge = " .,;:!?|\"'()[]{}<>#*$%&_-/\\"
    e = []
    for word in words:
        w = word.lower().strip(edge)
        e.append(sum(field.emission[zlib.crc32(n.encode()) % toxicity.BUCKETS] for n in ("w" + w, "p4" + w[:4], "p5" + w[:5], "p6" + w[:6], "s" + w[-3:])))
    t = np.exp(field.transition)
    alpha, beta = [], [(1.0, 1.0)]
    for i, x in enumerate(e):
        o = math.exp(min(max(x, -30), 30))
        a = (1.0, o) if not i else (alpha[-1][0] * t[0, 0] + alpha[-1][1] * t[1, 0], o * (alpha[-1][0] * t[0, 1] + alpha[-1][1] * t[1, 1]))
        alpha.append((a[0] / sum(a), a[1] / sum(a)))
    for x in reversed(e[1:]):
        o, b = math.exp(min(max(x, -30), 30)), beta[-1]
        c = (t[0, 0] * b[0] + t[0, 1] * o * b[1], t[1, 0] * b[0] + t[1, 1] * o * b[1])
        beta.append((c[0] / sum(c), c[1] / sum(c)))
    marginals = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(alpha, reversed(beta[: len(e)]))]
    n, most = len(e), min(max([1e-6, *marginals]), 1 - 1e-6)
    total = sum(marginals)
    features = [1, math.log(most / (1 - most)), math.log(total + 1e-3), math.log(total / max(n, 1) + 1e-4), math.log1p(n) / 5]
    z = sum(f * w for f, w in zip(features, field.document))
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def test_toxicity_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "fool", "see", *(["damned", "idiots"] if i % 4 == 0 else [])], 12)), int(i % 4 == 0)) for i in range(200)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    field = toxicity.train(labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic"))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in toxicity.toxic_scores(docs, field).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == pytest.approx(plain_toxicity(text, field), abs=1e-9), text
    assert got[0] > 0.5 > got[1]


def plain_language(text, model):
    letters = re.sub(r"[\W\d_]+", " ", (text or "").lower())
    if not any(c.isalpha() for c in letters):
        return "und", 0.0
    m, c = 1 << 32, [ord(x) for x in letters]
    two = [(a * 0x9E3779B1 + b * 0x85EBCA77) % m for a, b in zip(c, c[1:])]
    every = [x * 0x165667B1 % m for x in c] + two + [(a * 0xC2B2AE3D + b * 0x27D4EB2F) % m for a, b in zip(two, c[2:])]
    counts = Counter((x ^ (x >> 15)) % language.BUCKETS for x in every)
    x = {k: math.log1p(n) * model.idf[k] for k, n in counts.items()}
    norm = max(math.sqrt(sum(v * v for v in x.values())), 1e-12)
    z = [(sum(model.weights[i, k] * v for k, v in x.items()) / norm + model.bias[i]) / model.temperature for i in range(len(model.langs))]
    p = [math.exp(v - max(z)) for v in z]
    best = max(range(len(p)), key=lambda i: p[i])
    return model.langs[best], p[best] / sum(p)


def test_language_scores(spark):
    lines = {"en": "the cat sat on the mat and saw the sea", "de": "die katze sitzt über den häusern und sieht die see", "fr": "le chat est là où il voit la mer été"}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.permutation(lines[lang].split())), lang) for i, lang in enumerate(rng.choice(list(lines), 120))]
    model = language.train(spark.createDataFrame([(int(i), t, str(x)) for i, t, x in rows], "doc_id long, text string, lang string"))
    df = sum(np.minimum(language.gram_counts(t), 1) for _, t, _ in rows)
    assert np.allclose(model.idf, np.log((1 + len(rows)) / (1 + df)) + 0.1)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    for i, text in enumerate(TEXTS):
        lang, score = plain_language(text, model)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-9), text
    assert got[1][0] == "en" and got[6][0] == "de" and got[10][0] == "fr"
