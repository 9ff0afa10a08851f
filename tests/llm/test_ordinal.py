"""The ordinal regression beside plain Python: its optimum, and its predictions on every kind of text."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import toxicity
from tallyspark.llm.common import texts_of


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def loss(rows, grade, weight, w, theta, decay):
    """Mean negative log-likelihood of the grades plus the penalty, by the definition of the model."""
    total = 0.0
    for words, g, share in zip(rows, grade, weight):
        latent = sum(w[k] for k in words)
        at_most = [0.0, *[sigmoid(t - latent) for t in theta], 1.0]
        total -= share * math.log(max(at_most[g + 1] - at_most[g], 1e-12))
    return total / sum(weight) + decay / 2 * sum(x * x for x in w)


def sample(seed, n=120, n_features=6):
    r = random.Random(seed)
    rows = [[k for k in range(n_features) if r.random() < 0.4] for _ in range(n)]
    pull = [2.0, 1.0, -1.0, 0.5, 0.0, -2.0]
    grade = [min(3, max(0, round(sum(pull[k] for k in x) + r.gauss(0.8, 1)))) for x in rows]
    weight = [1.0 + (i % 3) for i in range(n)]
    owner = np.array([i for i, x in enumerate(rows) for _ in x])
    feature = np.array([k for x in rows for k in x])
    return rows, grade, weight, owner, feature


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fit_is_the_optimum(seed):
    rows, grade, weight, owner, feature = sample(seed)
    decay = 1e-2
    w, theta = toxicity.fit_ordinal(owner, feature, np.array(grade), np.array(weight), 6, 4, decay, 4000)
    assert (np.diff(theta) > 0).all()
    best = loss(rows, grade, weight, w, theta, decay)
    for k in range(6 + 3):  # no small step along any parameter lowers the loss
        for step in (-0.05, 0.05):
            a, b = w.copy(), theta.copy()
            if k < 6:
                a[k] += step
            else:
                b[k - 6] += step
            if (np.diff(b) > 0).all():
                assert loss(rows, grade, weight, a, b, decay) > best - 1e-6


def test_predictions(spark):
    words = ["vile", "scum", "calm", "é1", "trash"]
    texts = [None, "", " \n", "vile", "Vile, vile! scum", "calm calm calm", "é1 trash.", "nothing known here", "vile scum trash " * 400, "a\tvile\x0bscum"]
    names = {}
    for x in words:
        _, n = toxicity.word_sets(next(texts_of(pa.array([x])))[2])
        names[x] = n[0]
    order = np.argsort(np.array([names[x] for x in words], np.uint64))
    pull = {"vile": 2.0, "scum": 1.5, "calm": -3.0, "é1": 0.25, "trash": 1.0}
    model = toxicity.Model(np.array([names[words[i]] for i in order], np.uint64), np.array([pull[words[i]] for i in order]), np.array([0.5, 2.0, 3.5]))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "vile"), (None, "vile"), (3, "calm")]
    frame = spark.createDataFrame([(i, t, 1, "x", True) for i, t in rows], "doc_id long, text string, grade int, p_toxic string, toxic boolean")

    def want(text):
        held = {x for x in words if x in [w.strip(".,!").lower() for w in (text or "").replace("\x0b", " ").split()]}
        latent = sum(pull[x] for x in held)
        c = [sigmoid(t - latent) for t in model.thresholds]
        p = [c[0], c[1] - c[0], c[2] - c[1], 1 - c[2]]
        return len(held), round(sum(1 - x for x in c), 6), p.index(max(p)), round(1 - c[0], 6), 1 - c[0] >= 0.5
    got = sorted((repr(r.doc_id), r.n_features, round(r.expected_severity, 5), r.grade, round(r.p_toxic, 5), r.toxic) for r in toxicity.predict(frame, model).collect())
    expected = [(repr(i), *want(t)) for i, t in rows]
    assert got == sorted((i, n, round(e, 5), g, round(p, 5), t) for i, n, e, g, p, t in expected)
