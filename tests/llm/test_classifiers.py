"""The two classifiers recomputed plainly: scores word by word, gradients by finite differences."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest

from talus.llm import quality as Q
from talus.llm import toxicity as T
from talus.llm._features import NAMES

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
TEXTS = ["you Stupid fool", "a kind word, a good day", "st-upid fools! you", "good, good day to you", "", "what a stuppid foolish thing you said to a kind fool of the day and on it goes", "kind people say kind words on a good day, and on it goes for more than one bag of words", "fool", "so kind", "thé kind day"]
TOXIC = np.array([1, 0, 1, 0, 0, 1, 0, 1, 0, 0])


def joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


def grams(word: bytes) -> list[int]:
    """Buckets of a word; their number is checked by hand."""
    data = np.frombuffer(word, np.uint8)
    buckets, _ = T.subwords(data, np.array([0]), np.array([len(data)]))
    assert len(buckets) == 1 + sum(max(0, len(word) + 2 - n + 1) for n in T.GRAMS)
    return buckets.tolist()


def bags_of(text: str) -> list[list[bytes]]:
    words = [w.lower() for w in WORD.findall(text.encode())]
    n = max(1, -(-len(words) // T.BAG))
    out = [[] for _ in range(n)]
    for i, w in enumerate(words):
        out[i * n // len(words)].append(w)
    return out


def plain_logit(text, vector):
    """Log of the mean of exp over bags of the mean over words of the mean over n-grams of ``vector(bucket)``."""
    margins = []
    for bag in bags_of(text):
        words = [sum(vector(g) for g in grams(w)) / len(grams(w)) for w in bag]
        margins.append(sum(words) / len(words) if words else 0.0)
    return margins


def test_toxicity_scores_word_by_word():
    r = np.random.default_rng(0)
    model = T.Model(r.normal(size=T.BUCKETS), 0.3, -0.7, -2.0)
    got = model.score(*joined(TEXTS))
    for text, s in zip(TEXTS, got, strict=True):
        logit = math.log(np.mean(np.exp(plain_logit(text, lambda g: model.value[g])))) + 0.3 - 0.7
        assert s == pytest.approx(1 / (1 + math.exp(-(logit if text else -2.0))), rel=1e-9)


def test_toxicity_is_trained_along_the_gradient(monkeypatch):
    """Three steps of Adam, with the gradient of the plainly written loss by finite differences, give the same model."""
    monkeypatch.setattr(T, "STEPS", 3)
    least, rate = 2, 0.25
    model = T.train(*joined(TEXTS), TOXIC, rate, least, 5)
    seen: dict[int, float] = {}
    for t in TEXTS:
        for w in {w for bag in bags_of(t) for w in bag}:
            for g in grams(w):
                seen[g] = seen.get(g, 0) + 1
    known = sorted(g for g, n in seen.items() if n >= least)
    place = {g: i for i, g in enumerate(known)}
    r = np.random.default_rng(5)
    v, w, b = r.normal(0, 0.02, (len(known), T.DIM)), r.normal(0, 0.5, (T.DIM, 2)), np.zeros(2)
    # rows of text x n-gram weights make the loss quick to evaluate often
    weights = []
    for t in TEXTS:
        rows = []
        for bag in bags_of(t):
            row = np.zeros(len(known))
            for word in bag:
                for g in grams(word):
                    if g in place:
                        row[place[g]] += 1 / len(grams(word)) / len(bag)
            rows.append(row)
        weights.append(np.array(rows))

    def loss(x):
        v, w, b = x[: v0].reshape(-1, T.DIM), x[v0 : v0 + 2 * T.DIM].reshape(T.DIM, 2), x[-2:]
        total = 0.0
        for rows, y in zip(weights, TOXIC, strict=True):
            z = rows @ v * T.SCALE @ w + b
            logit = np.log(np.mean(np.exp(z[:, 1] - z[:, 0])))
            total += np.log1p(np.exp(-logit if y else logit))
        return total / len(TOXIC) + T.DECAY / 2 * (v**2).sum() + 1e-4 / 2 * (w**2).sum()

    v0 = v.size
    x = np.concatenate([v.ravel(), w.ravel(), b])
    m, s = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, 4):
        g = np.zeros_like(x)
        for i in range(len(x)):
            h = np.zeros_like(x)
            h[i] = 1e-5
            g[i] = (loss(x + h) - loss(x - h)) / 2e-5
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        x = x - T.RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    v, w, b = x[:v0].reshape(-1, T.DIM), x[v0 : v0 + 2 * T.DIM].reshape(T.DIM, 2), x[-2:]
    assert np.flatnonzero(model.value).tolist() == known
    assert model.value[known] == pytest.approx(v @ (w[:, 1] - w[:, 0]) * T.SCALE, abs=1e-4) and model.bias == pytest.approx(b[1] - b[0], abs=1e-5)
    share = TOXIC.mean()
    assert model.shift == pytest.approx(math.log(rate / (1 - rate)) - math.log(share / (1 - share)))


def test_toxicity_odd_rows(spark):
    """Repeated rows, a text over the sampled bags, clashing columns, nulls; one class only gives zeros."""
    rows = [(i, TEXTS[i % len(TEXTS)] or "x", int(TOXIC[i % len(TEXTS)])) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "c", 1.0) for i, t, _ in rows] + [(0, TEXTS[0], "c", 1.0), (None, "fool", "c", 1.0), (500, None, "c", 1.0), (501, "kind day " * 9000, "c", 1.0), (502, "kind day " * 9000 + "stupid fool " * 8, "c", 1.0)], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(501, 0), (502, 1)], "doc_id long, toxic int")
    model = T.fit(docs, labels, least_texts=2)
    got = T.score(docs, model).collect()
    assert len(got) == len(rows) + 5 and all(0 <= g["score"] <= 1 for g in got)
    by: dict = {}
    for g in got:
        by.setdefault(g["doc_id"], set()).add(g["score"])
    assert all(len(v) == 1 for v in by.values()) and min(by[502]) > max(by[501])
    assert T.fit(docs, labels.where("toxic = 0")) is None and {g["score"] for g in T.score(docs, None).collect()} == {0.0}
    assert T.score(docs.limit(0), model).count() == 0


def test_quality_risk_and_gradient(monkeypatch):
    """The slopes of the non-negative risk, where it counts and where it is negative, and the steps they make, against finite differences."""
    r = np.random.default_rng(1)
    for shift in (0.0, 3.0):  # 3: positives among the unlabelled would weigh more than there are, so the risk is turned
        pos, unl = r.normal(1, 1, (30, 4)), r.normal(shift - 1, 1, (40, 4))
        caught = []
        monkeypatch.setattr(Q, "STEPS", 1)
        monkeypatch.setattr(Q, "class_prior", lambda p, u: 0.9)
        plain = Q.Network.step
        monkeypatch.setattr(Q.Network, "step", lambda self, z, h, slope: caught.append((self, z, slope.copy())) or plain(self, z, h, slope))
        net = Q.fit_arrays(pos, unl)
        monkeypatch.setattr(Q.Network, "step", plain)
        fresh = Q.Network(np.concatenate([pos, unl]), 0)
        z = np.clip((np.concatenate([pos, unl]) - np.concatenate([pos, unl]).mean(axis=0)) / (np.concatenate([pos, unl]).std(axis=0) + 1e-6), -6, 6)
        out = np.array([sum(math.tanh(sum(x[i] * fresh.p[0][i, k] for i in range(4)) + fresh.p[1][k]) * fresh.p[2][k] for k in range(Q.HIDDEN)) + fresh.p[3][0] for x in z])
        loss = lambda o, y: math.log1p(math.exp(-o if y else o))

        def risk(o):
            plus = 0.9 * np.mean([loss(x, 1) for x in o[:30]])
            rest = np.mean([loss(x, 0) for x in o[30:]]) - 0.9 * np.mean([loss(x, 0) for x in o[:30]])
            return plus + rest if turned >= 0 else -rest

        turned = np.mean([loss(x, 0) for x in out[30:]]) - 0.9 * np.mean([loss(x, 0) for x in out[:30]])
        want = []
        for i in range(70):
            h = np.zeros(70)
            h[i] = 1e-6
            want.append((risk(out + h) - risk(out - h)) / 2e-6)
        slope = caught[0][2]
        assert slope == pytest.approx(want, abs=1e-8)
        # the first moment of Adam's first step is a tenth of the gradient of sum(slope * out), and the weight decay
        for k in range(4):
            at = tuple(0 for _ in fresh.p[k].shape)
            moved = [p.copy() for p in fresh.p]
            ends = []
            for d in (1e-6, -1e-6):
                moved[k][at] = fresh.p[k][at] + d
                ends.append(float(slope @ (np.tanh(z @ moved[0] + moved[1]) @ moved[2] + moved[3][0])))
            assert net.m[k][0][at] == pytest.approx(0.1 * ((ends[0] - ends[1]) / 2e-6 + 1e-4 * fresh.p[k][at]), abs=1e-7)
        o = np.array([[sum(math.tanh(sum(x[i] * net.p[0][i, k] for i in range(4)) + net.p[1][k]) * net.p[2][k] for k in range(Q.HIDDEN)) + net.p[3][0]] for x in z])
        assert net.score(np.concatenate([pos, unl])) == pytest.approx(1 / (1 + np.exp(-o[:, 0])), rel=1e-9)


def test_quality_odd_rows(spark):
    """Few positives keep everything; repeated rows, null ids, nulls and clashing columns; the pipeline's stage drops what is unlike the positives."""
    r = np.random.default_rng(2)
    good = lambda: " ".join("".join(r.choice(list("abcdefgh"), 5)) for _ in range(60)) + "."
    bad = lambda: "!!! $$$ WIN 777 " * 12
    rows = [(i, good() if i % 2 else bad() + str(i)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 5.0, "x") for i, t in rows] + [(1, rows[1][1], 5.0, "x"), (None, rows[3][1], 5.0, "x"), (None, rows[2][1], 5.0, "x"), (900, None, 5.0, "x"), (901, "", 5.0, "x")], "doc_id long, text string, score double, positive string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    texts = [k["text"] for k in kept.collect()]
    assert sum("$$$" in (t or "") for t in texts) == 0 and len([t for t in texts if t]) >= 190 and texts.count(rows[1][1]) == 2
    few = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    assert Q.fit(docs, few) is None and Q.keep_good(docs, few).count() == docs.count()
    assert len(NAMES) == 20
