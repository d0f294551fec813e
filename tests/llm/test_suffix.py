"""Suffix-array dedup against counting every string, and its arrays against plain sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from talus.llm import suffix


def brute(texts, window=suffix.WINDOW):
    """(bytes, removed, runs, digest of what stays) of each text."""
    raw, places = [(t or "").encode() for t in texts], {}
    for i, b in enumerate(raw):
        for s in range(len(b) - window + 1):
            places.setdefault(b[s : s + window], []).append((i, s))
    gone = [np.zeros(len(b), bool) for b in raw]
    for found in places.values():
        for i, s in found if len(found) > 1 else ():
            gone[i][s : s + window] = True
    runs = [int((np.diff(np.concatenate([[0], g.astype(int), [0]])) == 1).sum()) for g in gone]
    return [(len(b), int(g.sum()), n, hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()) for b, g, n in zip(raw, gone, runs, strict=True)]


@pytest.mark.parametrize("induced", ["_induced_in_buckets", "_induced_by_rows"])
def test_arrays(induced, monkeypatch):
    rng = np.random.default_rng(3)
    for name in ("_induced_in_buckets", "_induced_by_rows"):
        monkeypatch.setattr(suffix, name, getattr(suffix, induced))
    for _ in range(200):
        k = int(rng.integers(1, 5))
        s = np.append(rng.integers(1, k + 1, int(rng.integers(0, 60))), 0)
        sa = suffix.suffix_array(s, k + 1)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())  # noqa: B023
        shared = suffix.common_prefixes(s, sa)
        for a, b in zip(sa[:-1], sa[1:], strict=True):
            n = next(n for n in range(len(s)) if s[a + n] != s[b + n])
            assert shared[b] == n


def _texts():
    rng = np.random.default_rng(4)
    words = ["ab", "cde", "füg", "hij", "k", "lmno", "pqr", "stü", "vw", "xyz"]
    some = lambda n: " ".join(rng.choice(words, n))
    texts = [some(int(rng.integers(0, 400))) for _ in range(40)]
    passage = some(90)
    for i in range(0, 40, 3):
        at = int(rng.integers(0, len(texts[i]) + 1))
        texts[i] = texts[i][:at] + passage + texts[i][at:]
    texts += texts[:8] + [None, "", "a" * 1000, "ab" * 700, passage, passage[5:], some(30), "x" + texts[0][3:], (passage + some(3)) * 5]
    return texts + [texts[2][:150] + c + texts[2][151:] for c in "QRS"]


@pytest.mark.parametrize("many", [suffix.MANY, 1])
def test_removes_what_repeats(spark, many, monkeypatch):
    """Nulls, empty texts, copies, near-copies, runs; a null and a repeated id; a clashing column. many = 1: every anchor counts its windows."""
    texts = _texts()
    rows = [(None if i == 3 else min(i, 50), i, t, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, place long, text string, kept int").repartition(5)
    got = {r["place"]: (r["n_bytes"], sum(x["stop"] - x["start"] for x in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.remove_repeats(df, many).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_long_text_in_slices(monkeypatch):
    """A text over a slice: pieces of neighbouring slices hold every window once."""
    monkeypatch.setattr(suffix, "SLICE", 1000)
    data = np.random.default_rng(5).integers(97, 101, 4321).astype(np.uint8)
    seen = np.zeros(len(data), int)
    for _, part, off, at in suffix._slices(data, np.array([0, len(data)])):
        for _, start, n, *_ in zip(*suffix.pieces(part, off), strict=True):
            seen[at + start : at + start + n] += 1
    assert (seen[: len(data) - suffix.WINDOW + 1] == 1).all() and not seen[len(data) - suffix.WINDOW + 1 :].any()


def test_empty_table(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in suffix.query(spark, sf_dir).collect()}
    assert got == {r[0]: x for r, x in zip(rows, brute([r[1] for r in rows]), strict=True)}
