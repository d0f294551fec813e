"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; unlabelled ones are a sample of the web text itself; no negative label is used. A small
network over text statistics (``_features``) minimises the non-negative unbiased risk pi R+(P) + max(0, R-(U) - pi R-(P)) with logistic loss: where the second term
falls under zero its gradient is turned round. The class prior pi is estimated first: a scorer of P against U is fitted on one half, and on the
other half pi is the least ratio of the shares of U and P above a score, over scores that a tenth of P reaches, with a bound for chance.

The model is fitted on at most ``positives`` and ``unlabelled`` documents (bounds of the sample in rows; texts are whole), on the driver, from features the executors compute;
scoring is one pass over all documents without a shuffle.

Cases: a null text counts as empty; an empty text has the features zero and gets their score; without ``LEAST`` positives there is no model and every score is 1
(nothing is known against any text); repeated rows give repeated results; null ids are scored; labels of unknown ids are ignored; other columns are kept by ``keep_good`` and
not read by ``score``. Texts of any length are scored whole; an empty table gives an empty result; of different texts under one sampled doc_id
one is learnt from (the least row of features).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm._features import NAMES, text_features
from talus.llm._labels import HELD_OUT, first_ids
from talus.llm._store import small_batches
from talus.llm._text import buffers, slices

#: Bounds of the sample in rows, and the fewest of either kind that a model is fitted on.
POSITIVES, UNLABELLED, LEAST = 3000, 6000, 20
HIDDEN, STEPS, RATE = 24, 300, 0.02


def _features(rest: list[str]):
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for lo, hi in slices(offsets, 1 << 18):
                x = text_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
                yield pa.record_batch([*(batch.column(c).slice(lo, hi - lo) for c in rest), flat], [*rest, "x"])

    return run


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Network:
    """One hidden layer over standardised features."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        r = np.random.default_rng(seed)
        self.mean, self.dev = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.p = [r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.m = [(np.zeros_like(w), np.zeros_like(w)) for w in self.p]
        self.t = 0

    def ready(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.dev, -6, 6)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def step(self, z: np.ndarray, h: np.ndarray, slope: np.ndarray) -> None:
        """Adam on the gradient that the outputs' slopes give, with a little weight decay."""
        back = slope[:, None] * self.p[2] * (1 - h * h)
        grads = [z.T @ back, back.sum(axis=0), h.T @ slope, slope.sum(keepdims=True)]
        self.t += 1
        for w, g, (m, v) in zip(self.p, grads, self.m, strict=True):
            g = g + 1e-4 * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(self.ready(x))[1])


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among the unlabelled."""
    net = Network(np.concatenate([pos, unl]), seed=1)
    z = net.ready(np.concatenate([pos[::2], unl[::2]]))
    n = len(pos[::2])
    want = np.concatenate([np.full(n, 0.5 / n), np.full(len(z) - n, 0.5 / (len(z) - n))])
    y = np.concatenate([np.ones(n), np.zeros(len(z) - n)])
    for _ in range(100):
        h, out = net.forward(z)
        net.step(z, h, (sigmoid(out) - y) * want)
    p, u = np.sort(net.score(pos[1::2])), np.sort(net.score(unl[1::2]))
    cuts = p[: max(1, int(0.9 * len(p)))]
    above = lambda s: 1 - np.searchsorted(s, cuts, "left") / len(s)
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = int(((above(u) + slack) / above(p)).argmin())
    return float(np.clip(above(u)[best] / above(p)[best], 0.02, 0.98))


def fit_arrays(pos: np.ndarray, unl: np.ndarray, seed: int = 0) -> Network:
    """Non-negative unbiased risk, full batches."""
    pi, net = class_prior(pos, unl), Network(np.concatenate([pos, unl]), seed)
    z, n = net.ready(np.concatenate([pos, unl])), len(pos)
    for _ in range(STEPS):
        h, out = net.forward(z)
        s = sigmoid(out)
        minus = np.logaddexp(0, out)  # the loss of a negative
        rest = minus[n:].mean() - pi * minus[:n].mean()
        slope = np.zeros(len(out))
        if rest >= 0:
            slope[:n] = pi * (s[:n] - 1) / n - pi * s[:n] / n
            slope[n:] = s[n:] / (len(out) - n)
        else:
            slope[:n], slope[n:] = pi * s[:n] / n, -s[n:] / (len(out) - n)
        net.step(z, h, slope)
    net.prior = pi
    return net


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Network | None:
    """docs (doc_id, text), labels (doc_id, quality); only labels that are not held out are read."""
    small_batches(docs.sparkSession)
    pos = first_ids(labels.where("quality = 1"), positives).withColumn("positive", F.lit(1))
    unl = first_ids(docs.select("doc_id"), unlabelled).withColumn("positive", F.lit(0))
    ids = F.broadcast(pos.unionByName(unl))  # positives + unlabelled rows at most
    some = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").join(ids, "doc_id")
    rows = some.mapInArrow(_features(["doc_id", "positive"]), "doc_id long, positive int, x array<double>")
    rows = rows.groupBy("doc_id", "positive").agg(F.min("x").alias("x")).orderBy("positive", "doc_id").toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, len(NAMES))
    own = rows.column("positive").to_numpy() == 1
    return fit_arrays(x[own], x[~own]) if own.sum() >= LEAST and (~own).sum() >= LEAST else None


def _score(net: Network | None, rest: list[str]):
    inner = _features(rest)

    def run(batches):
        for batch in inner(batches):
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
            s = net.score(x) if net is not None else np.ones(len(x))
            yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(s)], [*rest, "score"])

    return run


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, score of each row of docs."""
    small_batches(docs.sparkSession)
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(_score(net, ["doc_id"]), "doc_id long, score double")


def _filter(net: Network | None, least: float):
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for lo, hi in slices(offsets, 1 << 18):
                x = text_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                s = net.score(x) if net is not None else np.ones(len(x))
                yield batch.slice(lo, hi - lo).filter(pa.array(s >= least))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows of docs that score ``least`` or more, unchanged."""
    return docs.mapInArrow(_filter(fit(docs, labels), least), docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, net).selectExpr("doc_id", f"{HELD_OUT} AS held_out", "score", "CASE WHEN score >= 0.7 THEN 1 ELSE 0 END AS predicted")


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
