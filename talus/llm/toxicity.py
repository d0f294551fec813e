"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word (letters, digits and non-ASCII characters, lower-cased) is the mean of the vectors of its character n-grams (``GRAMS`` bytes, with its ends marked) and of the whole
word; a bag is the mean of its words, and two softmax weights give its classes. Vectors and weights are trained together by Adam with the exact gradient. A misspelt
word shares most of its n-grams with the word, and so most of its vector. A document is a row of bags of ``BAG`` words; its odds are the
mean of its bags' odds, in training as in scoring, so a few words in a long text aren't averaged away (README has the figures with one bag a text).

Only n-grams that ``LEAST_TEXTS`` of the sampled documents share have a vector. The sample is bounded in rows (``positives`` toxic and ``negatives`` other labelled documents) and
in words: of a text of more than ``BAGS`` bags so many go in, spread evenly over the whole of it. The logits are then moved by the
difference between the sample's and the labels' rate of toxic rows. Scoring takes every whole text, in one pass without a shuffle: vectors and weights fold into one number for each n-gram.

Cases: a null text counts as empty; a text without words scores the rate of toxic labels; without labels of both classes every score is 0; repeated rows give
repeated results; of different texts under one labelled doc_id the least is learnt from; null ids are scored, never learnt from; texts of any
length are scored whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm._labels import HELD_OUT, first_ids
from talus.llm._store import small_batches
from talus.llm._text import LOWER, PUNCT, Words, buffers, mix, slices

#: Bounds of the sample: rows by label, and bags of a text. Texts that must share an n-gram.
POSITIVES, NEGATIVES, BAGS, LEAST_TEXTS = 800, 1600, 500, 4
GRAMS, BUCKETS, BAG = (3, 4, 5), 1 << 18, 8
DIM, STEPS, RATE, SCALE, DECAY = 4, 40, 0.05, 8.0, 3e-4
_PLACE = np.array([pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64) for i in range(8)], np.uint64)


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams and the whole of each word, and the number of its word."""
    size = end - start + 2
    last = np.cumsum(size)
    first = last - size
    flat = np.zeros(int(last[-1]) if len(size) else 0, np.uint64)
    word = np.repeat(np.arange(len(size)), size)
    inner = np.ones(len(flat), bool)
    inner[first], inner[last - 1] = False, False
    at = np.arange(len(flat))
    flat[inner] = LOWER[data[(start[word] + at - first[word] - 1)[inner]]].astype(np.uint64) + np.uint64(1)
    buckets, words = [], []
    for n in GRAMS:
        if len(flat) < n:
            continue
        h = np.zeros(len(flat) - n + 1, np.uint64)
        for j in range(n):
            h += flat[j : len(flat) - n + 1 + j] * _PLACE[j]
        ok = at[: len(h)] + n <= last[word[: len(h)]]
        buckets.append((mix(h[ok] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
        words.append(word[: len(h)][ok])
    whole = np.add.reduceat(mix(flat + ((at - first[word]).astype(np.uint64) << np.uint64(9))), first) if len(size) else np.zeros(0, np.uint64)
    buckets.append((mix(whole) % np.uint64(BUCKETS)).astype(np.int64))
    words.append(np.arange(len(size)))
    return np.concatenate(buckets), np.concatenate(words)


class Bags:
    """Texts as bags of words over the distinct words of a batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = Words(data, offsets, PUNCT)
        _, at, self.word = np.unique(w.hash, return_index=True, return_inverse=True)
        self.bucket, self.of = subwords(data, w.start[at], w.end[at])
        self.parts = np.maximum(1, np.bincount(self.of, minlength=len(at)))
        n = np.diff(w.first)
        bags = np.maximum(1, -(-n // BAG))
        self.first_bag = np.concatenate([[0], np.cumsum(bags)])
        place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)
        # as equal in size as can be, so a short rest isn't a bag
        self.bag = np.repeat(self.first_bag[:-1], n) + place * np.repeat(bags, n) // np.repeat(n, n)
        self.size = np.maximum(1, np.bincount(self.bag, minlength=int(self.first_bag[-1])))

    def bag_means(self, value: np.ndarray) -> np.ndarray:
        """Mean over a bag's words of the mean over their n-grams of one number for each bucket."""
        word = np.bincount(self.of, value[self.bucket], len(self.parts)) / self.parts
        return np.bincount(self.bag, word[self.word], len(self.size)) / self.size


class Model:
    def __init__(self, value: np.ndarray, bias: float, shift: float, rate_logit: float):
        self.value, self.bias, self.shift, self.rate_logit = value, bias, shift, rate_logit

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bags = Bags(data, offsets)
        margin = bags.bag_means(self.value)
        most = np.maximum.reduceat(margin, bags.first_bag[:-1])
        text = np.repeat(np.arange(len(most)), np.diff(bags.first_bag))
        logit = most + np.log(np.add.reduceat(np.exp(margin - most[text]), bags.first_bag[:-1]) / np.diff(bags.first_bag)) + self.bias + self.shift
        empty = np.ones(len(logit), bool)
        empty[np.searchsorted(bags.first_bag, bags.bag, "right") - 1] = False
        return np.where(empty, 1 / (1 + np.exp(-self.rate_logit)), 1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def train(data: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, rate: float, least_texts: int = LEAST_TEXTS, seed: int = 3) -> Model:
    r = np.random.default_rng(seed)
    bags = Bags(data, offsets)
    text = np.searchsorted(bags.first_bag, np.arange(len(bags.size)), "right") - 1
    # n-grams that enough texts share; others keep the vector 0
    pairs = np.unique(text[bags.bag].astype(np.int64) * len(bags.parts) + bags.word)
    spread = np.bincount(pairs % len(bags.parts), minlength=len(bags.parts))
    texts = np.bincount(bags.bucket, spread[bags.of], BUCKETS)
    known = np.flatnonzero(texts >= least_texts)
    place = np.full(BUCKETS, -1)
    place[known] = np.arange(len(known))
    some = place[bags.bucket] >= 0
    col, word = place[bags.bucket[some]], bags.of[some]
    v, w = r.normal(0, 0.02, (len(known), DIM)), r.normal(0, 0.5, (DIM, 2))
    b = np.zeros(2)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (v, w, b)]
    y = toxic.astype(np.int64)
    n, n_bags = len(y), np.diff(bags.first_bag)
    for t in range(1, STEPS + 1):
        word_vec = np.stack([np.bincount(word, v[col, d], len(bags.parts)) for d in range(DIM)], axis=1) / bags.parts[:, None]
        bag_vec = np.stack([np.bincount(bags.bag, word_vec[bags.word, d], len(bags.size)) for d in range(DIM)], axis=1) / bags.size[:, None] * SCALE
        margin = (bag_vec @ w + b) @ np.array([-1.0, 1.0])
        # log of the mean of exp over a text's bags: its gradient is shared by the bags by how toxic they are
        most = np.maximum.reduceat(margin, bags.first_bag[:-1])
        e = np.exp(margin - most[text])
        total = np.add.reduceat(e, bags.first_bag[:-1])
        p = 1 / (1 + np.exp(-np.clip(most + np.log(total / n_bags), -40, 40)))
        part = ((p - y) / n)[text] * e / total[text]
        slope = np.stack([-part, part], axis=1)
        gw, gb = bag_vec.T @ slope, slope.sum(axis=0)
        grad_bag = slope @ w.T * SCALE / bags.size[:, None]
        grad_word = np.stack([np.bincount(bags.word, grad_bag[bags.bag, d], len(bags.parts)) for d in range(DIM)], axis=1) / bags.parts[:, None]
        gv = np.stack([np.bincount(col, grad_word[word, d], len(known)) for d in range(DIM)], axis=1)
        for x, g, (m, s) in zip((v, w, b), (gv + DECAY * v, gw + 1e-4 * w, gb), state, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            x -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    value = np.zeros(BUCKETS)
    value[known] = v @ (w[:, 1] - w[:, 0]) * SCALE
    share = y.mean()
    logit = lambda q: float(np.log(q / (1 - q)))
    return Model(value, float(b[1] - b[0]), logit(rate) - logit(share), logit(rate))


def excerpt(text: str, bags: int) -> str:
    """The whole text if it has so many bags or fewer, else so many, spread evenly over it."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    w = Words(data, np.array([0, len(data)]), PUNCT)
    n = len(w.start) // BAG
    if n <= bags:
        return text
    at = np.arange(bags) * n // bags * BAG
    return "\n".join(data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(w.start[at].tolist(), w.end[at + BAG - 1].tolist(), strict=True))


def _excerpts(bags: int):
    def run(batches):
        for batch in batches:
            texts = [excerpt(t or "", bags) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(texts, pa.string())], ["doc_id", "toxic", "text"])

    return run


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, bags: int = BAGS, least_texts: int = LEAST_TEXTS) -> Model | None:
    """docs (doc_id, text), labels (doc_id, toxic); only labels that are not held out are read."""
    small_batches(docs.sparkSession)
    own = labels.where(f"NOT ({HELD_OUT})")
    n, toxic = own.agg(F.count("toxic"), F.sum("toxic")).first()
    if not n or not toxic or toxic == n:
        return None
    ids = first_ids(own.where("toxic = 1"), positives).withColumn("toxic", F.lit(1)).unionByName(first_ids(own.where("toxic = 0"), negatives).withColumn("toxic", F.lit(0)))
    some = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").join(F.broadcast(ids), "doc_id")  # positives + negatives rows at most
    some = some.mapInArrow(_excerpts(bags), "doc_id long, toxic int, text string").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = some.orderBy("doc_id", "toxic").toArrow()
    y = rows.column("toxic").to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    return train(*buffers(rows.column("text")), y, min(max(toxic / n, 1e-3), 1 - 1e-3), least_texts)


def _score(model: Model | None):
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for lo, hi in slices(offsets, 1 << 18):
                s = model.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) if model is not None else np.zeros(hi - lo)
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(s)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of each row of docs."""
    small_batches(docs.sparkSession)
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(_score(model), "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).selectExpr("doc_id", f"{HELD_OUT} AS held_out", "score", "CASE WHEN score >= 0.3 THEN 1 ELSE 0 END AS predicted")


QUERIES = {"op4_toxicity": op4_toxicity}
