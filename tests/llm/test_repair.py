"""Conversation repair against the least (cost, audit) over all edits, by plain dynamic programming."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from talus.llm import repair as R

DATA = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """rows (role, text, fault): least (cost, audit, lines) over every way; up to three turns are inserted at a place."""
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    full = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, inserted):
        found = []
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            more = fault == "truncated"
            c, a, lines = best(i + 1, state, 0)
            found.append((c + 3, "D" + a, lines))
            for x, y in legal:
                if x == state and fault not in ("blank", "duplicate"):
                    if role[:1] == y:
                        c, a, lines = best(i + 1, legal[x, y], 0)
                        found.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
                    if y in full:
                        c, a, lines = best(i + 1, legal[x, y], 0)
                        found.append((c + 2 + more, "R" + a, (f"{full[y]}:{text}", *lines)))
        for x, y in legal:
            if x == state and y in full and inserted < 3:
                c, a, lines = best(i, legal[x, y], inserted + 1)
                found.append((c + 2, "I" + a, (f"{full[y]}:", *lines)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def plain(rows):
    """rows (turn, role, text), nulls made spaces, in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = BLANK.findall(text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, lines = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults, strict=True)])
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), list(lines)


def damaged(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        x = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
        out += [(c, turn, "user" if x == 4 else role, text)] * (0 if x == 0 else 2 if x == 3 else 1)
    return out


def _random(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", "", "User", None], ["Hi.", "ok", "Yes! ", "", " \t", "what?\n", "a.b", None, "Ende…", "well."]
    return [(None if rng.random() < 0.05 else int(rng.integers(0, n)), roles[min(int(rng.integers(0, 12)) % 8, 6) if rng.random() < 0.4 else int(rng.integers(0, 2))], texts[int(rng.integers(0, len(texts)))] if rng.random() < 0.6 else f"t{rng.integers(0, 50)}.") for _ in range(n)]


@pytest.mark.parametrize("block", [R.BLOCK, 3])
def test_against_all_edits(spark, block):
    """Random conversations with nulls, odd roles and repeated rows; a null id; cut into blocks and whole."""
    rng = np.random.default_rng(9)
    rows = [(None if c == 0 else c, *r) for c in range(120) for r in _random(rng, int(rng.integers(1, 14)))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, c string").repartition(3)
    table, fixed = R.report(df, block)
    got = {r[0]: tuple(r)[1:] for r in table.collect()}
    lines: dict = {}
    for r in sorted(fixed.collect(), key=lambda r: (r["place"], r["part"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for c in {r[0] for r in rows}:
        want, fine = plain([(t, " " if role is None else role, " " if text is None else text) for i, t, role, text in rows if i == c])
        assert got[c] == want, c
        assert lines.get(c, []) == fine
    assert len(got) == 120


def test_long_conversation(spark):
    """Thousands of turns over many blocks: the audit keeps, deletes and inserts as a whole one would."""
    rng = np.random.default_rng(2)
    rows = [(i, str(rng.choice(["user", "assistant"])), f"text {i}" + "." * int(rng.integers(0, 2))) for i in range(3000)]
    one = lambda block: R.report(spark.createDataFrame([(1, *r) for r in rows], "conv_id long, turn int, role string, text string"), block)[0].collect()
    assert one(100) == one(10_000)


def test_query_and_empty(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in R.query(spark, DATA).collect()}
    bad = damaged(rows)
    assert got == {c: plain([r[1:] for r in bad if r[0] == c])[0] for c in {r[0] for r in rows}}
    assert R.report(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))[0].count() == 0
