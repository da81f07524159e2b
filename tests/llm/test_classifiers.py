"""Classifiers against plain definitions, and fitted models on odd rows."""

import math
import unicodedata

import numpy as np
import pytest

from racelab.llm import language_id, quality, sample, toxicity
from racelab.llm import queries as q

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "x" * 3000), (4, "x" * 3000), (None, "one two"), (5, "word " * 20000)]


def frame(spark, rows=ODD):
    return spark.createDataFrame([(i, t, 9, 0.5, [1]) for i, t in rows], "doc_id long, text string, n int, score double, spans array<int>")


def test_passage_scores_are_the_formula():
    """A bag's score by the definition of gated attention, one passage at a time."""
    rng = np.random.default_rng(1)
    net = quality.Attention(*(rng.normal(size=s) for s in ((quality._DIM, 6), (6, 4), (6, 4), (4,), (6,))), 0.3)
    x = rng.normal(size=(7, quality._DIM))
    h = [np.tanh(net.e.T @ row) for row in x]
    gate = [math.exp(sum(math.tanh(net.v[:, k] @ v) / (1 + math.exp(-(net.u[:, k] @ v))) * net.a[k] for k in range(4))) for v in h]
    w = [g / sum(gate) for g in gate]
    z = sum(a * v for a, v in zip(w, h))
    got, focus = net.score(x)
    assert math.isclose(got, 1 / (1 + math.exp(-(z @ net.c + net.d)))) and np.allclose(focus, w)


def test_passages_see_words():
    maker = quality.Passages(4)
    a, b = maker.describe("abcd efgh ijkl mnop qrst"), maker.describe("abce efgh ijkl mnop qrst")
    assert a.shape == (2, quality._DIM) and (a[0] != b[0]).any() and (a[1] == b[1]).all()
    assert (a[0, : quality._SHARES] == b[0, : quality._SHARES]).all()


def test_quality_learns_words():
    rng = np.random.default_rng(3)
    maker, bags, y = quality.Passages(16), [], []
    for k in range(400):
        words = rng.choice(["alpha", "gamma", "delta", "theta"], 60)
        words[20] = ("kappa", "sigma")[k % 2]
        bags.append(maker.describe(" ".join(words)))
        y.append(k % 2)
    net = quality.fit(bags[:300], y[:300], epochs=60)
    assert np.mean([(net.score(b)[0] >= 0.5) == v for b, v in zip(bags[300:], y[300:])]) >= 0.9


def test_language_counts_and_scores_by_definition():
    text = "Ça va? 12 là-bas"
    s = " " + "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()) + " "
    while "  " in s:
        s = s.replace("  ", " ")
    c = language_id.counts(text)
    assert c.sum() == sum(len(s) - k for k in range(3))
    assert (np.sort(c[c > 0])[::-1][:3] >= 1).all() and (c > 0).sum() <= len({s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1)})
    model = language_id.LanguageModel(["a", "b"], np.linspace(1, 2, len(c)), np.random.default_rng(0).normal(size=(len(c) + 1, 2)), 0.7)
    x = np.append(np.log1p(c) * model.idf, 0)
    x /= math.sqrt((x * x).sum())
    x[-1] = 0.2
    z = np.exp(x @ model.weights / 0.7)
    lang, p = model.predict(text)
    assert math.isclose(p, (z / z.sum()).max()) and lang == "ab"[int(z.argmax())]


@pytest.mark.parametrize("text", ["", "12 ?!", "́", "́ ⃠ 1"])
def test_no_letter_is_undetermined(text):
    model = language_id.LanguageModel(["a", "b"], np.ones(language_id.DIM), np.ones((language_id.DIM + 1, 2)))
    assert model.predict(text) == ("und", 0.0) and model.predict(text + "é")[0] == "a"


def test_labels_that_disagree(spark):
    docs = spark.createDataFrame([(7, "b"), (7, "a"), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 0), (7, 1), (8, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    assert sample.labelled_texts(docs, labels, "toxic", 10, 1, 5) == [(7, "a", 1), (8, "", 0)]


def test_toxic_windows_cover_all_evidence():
    """Evidence far beyond the first 50 occurrences still teaches the model."""
    clean = [(k, " ".join(["calm"] * 30 + ["word"] * 30), 0) for k in range(30)]
    bad = [(k, " ".join(["nasty calm"] * 200 + ["vile word"] * 100), 1) for k in range(30, 60)]
    model = toxicity.fit(clean + bad, steps=40, batch=200)
    assert model.evidence("vile") > 1 and model.evidence("nasty") > 1 and model.evidence("calm") <= 0
    for text, low, high in ((clean[0][1], 0, 0.3), ("word calm " + bad[0][1], 0.7, 1)):
        each = [model.evidence(w) for w in text.split()]
        at = [i for i, s in enumerate(each) if s]
        p = model.marginals(at, [each[i] for i in at], len(each))
        assert low <= model.score(p) <= high and all(x > 0.5 for x in p)


def test_fitted_models_take_odd_rows(spark):
    docs, labels = q.table(spark, SF, "documents"), q.table(spark, SF, "labels")
    toxic, good = toxicity.train(docs, labels, 300), quality.train(docs, labels, 300)
    for make, model in ((toxicity.tag, toxic), (quality.score, good)):
        got = make(frame(spark), model).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1 and len({r.score for r in got if r.doc_id == 4}) == 1
        assert make(frame(spark, []), model).count() == 0
    langs = language_id.train(docs, 50)
    assert language_id.identify(frame(spark, []), langs).count() == 0


def test_offending_offsets(spark):
    docs = {r.doc_id: r.text for r in q.table(spark, SF, "documents").collect()}
    hits = [r for r in q.op3_toxicity_crf(spark, SF).collect() if r.spans]
    assert hits
    for r in hits:
        for span in r.spans.split(","):
            s, e = map(int, span.split(":"))
            assert not any(c.isspace() for c in docs[r.doc_id][s:e]) and e > s
