"""Components and rooted forests over edge tables.

Both work in rounds that are written to the shared folder. Before a round's shuffle each task contracts what it holds by itself, so that rounds are needed only for
what lies apart; whether a round was the last is counted while it is written."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.session import counted, cut, drop

#: Rows that a task contracts at a time.
CHUNK = 1 << 21


def _chunks(batches, columns: tuple[str, ...]):
    held, n = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
        n += len(batch)
        if n >= CHUNK:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def least_joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of an edge list and the least id that each reaches, by hooking larger roots to smaller ones and halving paths."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        ru, rv = root[u], root[v]
        open_ = ru != rv
        if not open_.any():
            return ids, ids[root]
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while (root[root] != root).any():
            root = root[root]


def _stars(batches):
    """Edges (u, v) as stars: each id of a chunk with the least one that it reaches there."""
    for u, v in _chunks(batches, ("u", "v")):
        ids, root = least_joined(u, v)
        far = ids != root
        yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(root[far])], names=["u", "v"])


_MARK = {"n": "count(*)", "hash": "sum(CAST(xxhash64(u, v) AS DECIMAL(38, 0)))"}


def star_roots(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, root): the smallest reachable id of every id that has an edge, without the driver.

    Alternating star contractions: a round joins every larger neighbour of u to the smallest one (large star), then every smaller one
    (small star). The minima are combined before the shuffle, so a hub costs a row a task. It ends when a round changes nothing."""
    local = lambda t: t.mapInArrow(_stars, "u long, v long")
    e, seen = counted(local(edges.where("a <> b").selectExpr("CAST(greatest(a, b) AS BIGINT) AS u", "CAST(least(a, b) AS BIGINT) AS v")), **_MARK)
    while seen["n"]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.join(least, "u").where("v > u AND v <> m").selectExpr("v AS u", "m AS v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("inline(array(struct(greatest(v, m) AS u, least(v, m) AS v), struct(u, m AS v)))").where("u <> v").distinct()
        old, (e, now) = e, counted(local(small).distinct(), **_MARK)
        drop(old)
        if now == seen:
            break
        seen = now
    return e.selectExpr("u AS id", "v AS root").union(e.selectExpr("v", "v").distinct())


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id), edges (a, b): (id, root), the smallest id reachable."""
    return nodes.join(star_roots(edges), "id", "left").selectExpr("id", "coalesce(root, id) AS root")


def followed(pid: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far each row's way leads within these rows: the id it leads to, whether it ends there, and whether it goes round in a circle."""
    order = np.argsort(pid, kind="stable")
    at = np.searchsorted(pid[order], parent)
    known = pid[order[np.minimum(at, len(pid) - 1)]] == parent
    to = np.where(known & (parent != pid), order[np.minimum(at, len(pid) - 1)], np.arange(len(pid)))
    for _ in range(len(pid).bit_length() + 1):
        to = to[to]
    round_ = to != to[to]
    # a row on a circle of whose length the steps are a multiple comes back to itself, though it has a way on
    round_ |= known[to] & (parent[to] != pid[to])
    return parent[to], (parent[to] == pid[to]) & ~round_, round_


def _ways(batches):
    for pid, parent in _chunks(batches, ("pid", "parent")):
        root, sink, round_ = followed(pid, parent)
        yield pa.RecordBatch.from_arrays([pa.array(pid), pa.array(root, mask=round_), pa.array(sink | round_)], names=["pid", "root", "ended"])


_OPEN = "count_if(NOT ended)"


def forest_roots(parents: DataFrame) -> DataFrame:
    """parents (pid, parent): (pid, root) by pointer jumping; root is null where the chain ends in a cycle of two or more.

    Each task first follows the ways within its own rows. A row that has come to its root (a row that is its own parent) asks no more, so the rows of a large tree
    meet at its root once."""
    ways = parents.selectExpr("CAST(pid AS BIGINT) AS pid", "CAST(parent AS BIGINT) AS parent").mapInArrow(_ways, "pid long, root long, ended boolean")
    known, seen = counted(ways, n="count(*)", open=_OPEN)
    done, todo, rounds, left = known.where("ended"), known.where("NOT ended"), 0, seen["open"]
    while left and rounds <= seen["n"].bit_length():
        far = todo.unionByName(done).selectExpr("pid AS root", "root AS far", "ended AS ends")
        new, now = counted(todo.select("pid", "root").join(far, "root").selectExpr("pid", "far AS root", "ends AS ended"), open=_OPEN)
        done, todo, left, rounds = done.unionByName(new.where("ended")), new.where("NOT ended"), now["open"], rounds + 1
    # what still asks after so many rounds goes round in a circle
    return done.select("pid", "root").unionByName(todo.selectExpr("pid", "CAST(NULL AS BIGINT) AS root"))


def least_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of an edge list that is sorted by weight, and the end of the tree of the least forest in which each hangs; ids below 0 are ends and aren't joined."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root, end = at[: len(a)], at[len(a) :], np.arange(len(ids)), ids < 0
    while True:
        ru, rv = root[u], root[v]
        open_ = (ru != rv) & ~(end[ru] & end[rv])
        if not open_.any():
            return ids, ids[root]
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        first = np.full(len(ids), len(u))
        for r in (ru, rv):
            np.minimum.at(first, r, np.arange(len(u)))
        who = np.flatnonzero((first < len(u)) & ~end)
        up = np.arange(len(ids))
        up[who] = ru[first[who]] + rv[first[who]] - who
        back = who[(up[up[who]] == who) & (who < up[who])]
        up[back] = back
        while (up[up] != up).any():
            up = up[up]
        root = up[root]


def _hung(batches):
    held = [[x.column(c).to_numpy(zero_copy_only=False) for c in "ab"] for x in batches if len(x)]
    if held:
        ids, end = least_forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        far = ids != end
        yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(end[far])], names=["pid", "parent"])


def flooded(edges: DataFrame, sources: DataFrame, at_once: int = CHUNK) -> DataFrame:
    """edges (a, b, w), sources (id, source); ids and sources from 0: (id, source), for every id that reaches one, the source at the end of the way whose largest w is least.

    That is the tree of the least spanning forest in which an id hangs. Boruvka's rounds build it: each tree without a source takes its least edge (ties by the two
    ids), trees that are joined become one, and of the edges between two trees the least stays. When no more than ``at_once`` edges are left a task does the remaining
    rounds, with the same result. w may be a struct."""
    mark = "coalesce(-1 - s{0}.source, {0})"
    s = [sources.selectExpr(f"id AS {c}", "source").alias(f"s{c}") for c in "ab"]
    key = edges.selectExpr("CAST(a AS BIGINT) AS a", "CAST(b AS BIGINT) AS b", "struct(w, least(a, b) AS i, greatest(a, b) AS j) AS k").where("a <> b")
    left = key.join(s[0], "a", "left").join(s[1], "b", "left").selectExpr(f"{mark.format('a')} AS a", f"{mark.format('b')} AS b", "k")
    own = sources.selectExpr("CAST(id AS BIGINT) AS id", "CAST(source AS BIGINT) AS source")
    hung = None
    while True:
        ends = left.where("a <> b AND (a >= 0 OR b >= 0)").selectExpr("greatest(a, b) AS a", "least(a, b) AS b", "k")
        e, seen = counted(ends.groupBy("a", "b").agg(F.min("k").alias("k")), n="count(*)")
        if not seen["n"]:
            break
        if seen["n"] <= at_once:
            step = cut(e.coalesce(1).sortWithinPartitions("k").select("a", "b").mapInArrow(_hung, "pid long, parent long"))
            if hung is None:
                return own.union(step.where("parent < 0").selectExpr("pid", "-1 - parent"))
            hung = hung.union(step)
            break
        # an end with a source (below 0) takes no edge
        took = cut(e.union(e.selectExpr("b", "a", "k")).where("a >= 0").groupBy("a").agg(F.min_by("b", "k").alias("parent")))
        back = took.selectExpr("a AS parent", "parent AS other")
        up = took.join(back, "parent", "left").selectExpr("a AS pid", "CASE WHEN other = a AND a < parent THEN a ELSE parent END AS parent")
        ways = cut(up.union(took.where("parent < 0").selectExpr("parent AS pid", "parent").distinct()))
        step = ways.where("pid <> parent")
        hung = step if hung is None else hung.union(step)
        root = forest_roots(ways)
        ra, rb = (root.selectExpr(f"pid AS {c}", f"root AS r{c}") for c in "ab")
        left = e.join(ra, "a", "left").join(rb, "b", "left").selectExpr("coalesce(ra, a) AS a", "coalesce(rb, b) AS b", "k")
    if hung is None:
        return own
    ends = hung.selectExpr("parent AS pid").distinct().join(hung.select("pid"), "pid", "left_anti").selectExpr("pid", "pid AS parent")
    return own.union(forest_roots(hung.union(ends)).where("root < 0 AND pid >= 0").selectExpr("pid", "-1 - root"))
