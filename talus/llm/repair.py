"""Conversation structure repair: the cheapest edits that make the roles alternate, as shortest paths by Dial's bucket queue.

A state machine reads the initials of roles: an optional system turn, then user and assistant in turn, ending after an assistant; nothing at all is legal
too. A node is a state after so many rows. Arcs keep a row (0), give it the role that the state allows (2), delete it (3), or insert an empty turn (2);
a row that isn't deleted though it's truncated costs 1 more, and a blank or duplicate row can only be deleted. Costs are small integers, so the queue is a
row of buckets: distances to the end are settled bucket by bucket. Among the cheapest ways the audit is the least in the order of letters (D, I, K, R): from the
start, the least letter whose arc is tight is taken each time (a state has one arc for each letter).

A conversation is cut into blocks of ``BLOCK`` rows, so that no task has to hold a long one. A block gives its costs from each state to each; a scan from the
last block to the first, which holds four numbers, adds them up; then each block is walked from each of the four states, and a scan from the first to the last picks
what follows on. Rows and edits meet by place. Only the digest of a whole conversation is one stream, which holds a hash and a letter or two for each row.

Cases: null roles and texts count as one space; a null conv_id is a conversation of its own; rows of a null turn come first, rows of one turn in the order of
role and text; a role with no legal initial (an empty one too) must be given another or deleted; repeated rows are duplicates; texts of any length are kept whole;
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.llm._store import Workspace, small_batches

#: Rows of a block. Costs; states 0 to 3 are the start, and after system, user and assistant.
BLOCK = 4096
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: What may be inserted, or given as role, in a state; what ends a conversation from it, and its cost.
GIVEN = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
END, TAIL = (0, 2 * INSERT, INSERT, 0), ("", "ua", "a", "")
FAR = 1 << 60
_SPACE = " \t\n\x0b\x0c\r"
_ARROW = {"c": pa.string(), "block": pa.int64()}


# shortest paths


def distances(rows: list[tuple[str, bool, int]], seeds) -> list[list[int]]:
    """rows: (initial, whether it must go, 1 if truncated); seeds: what it costs to go on from each state after the last one. For each row and state
    the least cost from before the row, by Dial's bucket queue over the arcs turned round."""
    n = len(rows)
    dist = [[FAR] * 4 for _ in range(n)] + [list(seeds)]
    base = min(seeds)
    buckets: list[list[tuple[int, int]]] = []

    def put(d: int, i: int, s: int) -> None:
        while len(buckets) <= d - base:
            buckets.append([])
        buckets[d - base].append((i, s))

    for s, d in enumerate(seeds):
        if d < FAR:
            put(d, n, s)
    at = 0
    while at < len(buckets):
        for i, to in buckets[at]:  # grows while it is read: no arc of cost 0 leads back
            d = at + base
            if dist[i][to] != d:
                continue
            arcs = []
            if i < n:
                arcs += [(i, s, INSERT) for s in range(4) if GIVEN[s][1] == to]
            if i:
                initial, must, cut = rows[i - 1]
                arcs.append((i - 1, to, DELETE))
                if not must:
                    arcs += [(i - 1, s, cut * TRUNCATED) for s in range(4) if NEXT[s].get(initial) == to]
                    arcs += [(i - 1, s, REROLE + cut * TRUNCATED) for s in range(4) if GIVEN[s][1] == to]
            for j, s, cost in arcs:
                if d + cost < dist[j][s]:
                    dist[j][s] = d + cost
                    put(d + cost, j, s)
        at += 1
    return dist


def walk(rows: list[tuple[str, bool, int]], dist: list[list[int]], state: int) -> tuple[str, int]:
    """The least tight way from a state: D, K, u and a for an inserted turn, U and A for a row given that role; and the state at its end."""
    out, i = [], 0
    while i < len(rows):
        initial, must, cut = rows[i]
        cut *= TRUNCATED
        letter, to = GIVEN[state]
        d = dist[i][state]
        if dist[i + 1][state] + DELETE == d:
            out.append("D")
            i += 1
        elif dist[i][to] + INSERT == d:
            out.append(letter)
            state = to
        elif not must and (kept := NEXT[state].get(initial)) is not None and dist[i + 1][kept] + cut == d:
            out.append("K")
            state, i = kept, i + 1
        else:
            out.append(letter.upper())
            state, i = to, i + 1
    return "".join(out), state


# streams over sorted rows


def _blocks(batches, columns: list[str]):
    """Rows of each block: ((c, block), [values of columns])."""
    key, held = None, []
    for batch in batches:
        for c, b, *values in zip(*(batch.column(x).to_pylist() for x in ("c", "block", *columns)), strict=True):
            if (c, b) != key:
                if held:
                    yield key, held
                key, held = (c, b), []
            held.append(values)
    if held:
        yield key, held


def _table(rows: list, **kinds) -> pa.RecordBatch:
    kinds = _ARROW | kinds
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds.values(), strict=True)], names=list(kinds))


def _chunks(rows, most: int = 1000):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held


def _through(batches):
    """Of each block: the cost from each state (before it) to each (after it)."""

    def rows():
        for (c, b), own in _blocks(batches, ["initial", "must", "cut"]):
            own = [tuple(x) for x in own]
            each = [distances(own, [0 if s == to else FAR for s in range(4)])[0] for to in range(4)]
            yield c, b, [each[to][s] for s in range(4) for to in range(4)]

    for part in _chunks(rows()):
        yield _table(part, through=pa.list_(pa.int64()))


def _togo(batches):
    """Blocks from the last: what it costs to go on after each, from each state."""

    def rows():
        last, now = object(), None
        for batch in batches:
            for c, b, t in zip(*(batch.column(x).to_pylist() for x in ("c", "block", "through")), strict=True):
                end = c != last
                now, last = (list(END) if end else now), c
                yield c, b, now, end
                now = [min(t[4 * s + to] + now[to] for to in range(4)) for s in range(4)]

    for part in _chunks(rows()):
        yield _table(part, togo=pa.list_(pa.int64()), last=pa.bool_())


def _walks(batches):
    """Of each block: the walk from each state and where it ends."""

    def rows():
        for (c, b), own in _blocks(batches, ["initial", "must", "cut", "togo", "last"]):
            steps = [tuple(x[:3]) for x in own]
            dist = distances(steps, own[0][3])
            ways = [walk(steps, dist, s) if dist[0][s] < FAR else ("", 0) for s in range(4)]
            yield c, b, [w for w, _ in ways], [e for _, e in ways], own[0][4]

    for part in _chunks(rows(), 100):
        yield _table(part, codes=pa.list_(pa.string()), ends=pa.list_(pa.int64()), last=pa.bool_())


def _chosen(batches):
    """Blocks from the first: the walk that follows on the one before."""

    def rows():
        conversation, state = object(), 0
        for batch in batches:
            for c, b, codes, ends, last in zip(*(batch.column(x).to_pylist() for x in ("c", "block", "codes", "ends", "last")), strict=True):
                state = 0 if c != conversation else state
                conversation = c
                code, state = codes[state], ends[state]
                yield c, b, code, TAIL[state] if last else ""

    for part in _chunks(rows(), 100):
        yield _table(part, code=pa.string(), tail=pa.string())


def _digests(batches):
    """Rows with their edits, in order: audit, cost and the hash of the repaired lines of each conversation."""

    def rows():
        key = None
        for batch in batches:
            for c, role, text, edit, cut in zip(*(batch.column(x).to_pylist() for x in ("c", "role", "text", "edit", "cut")), strict=True):
                if key is None or c != key[0]:
                    if key:
                        yield key[0], "".join(key[1]), key[2], key[3].hexdigest()
                    key = [c, [], 0, hashlib.sha256(), b""]
                for x in edit:
                    key[1].append("I" if x in "ua" else x if x in "DK" else "R")
                    key[2] += DELETE if x == "D" else (0 if x == "K" else INSERT if x in "ua" else REROLE) + (cut * TRUNCATED if x in "KUA" else 0)
                    if x != "D":
                        name = role if x == "K" else "user" if x in "uU" else "assistant"
                        key[3].update(key[4] + f"{name}:{text if x in 'KUA' else ''}".encode())
                        key[4] = b"\n"
        if key:
            yield key[0], "".join(key[1]), key[2], key[3].hexdigest()

    for part in _chunks(rows()):
        columns = list(zip(*part, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=["c", "audit", "cost", "repaired_sha256"])


# the operator


def numbered(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conversations (conv_id, turn, role, text) in order, with place, block and faults: blank, else duplicate, else truncated."""
    plain = rows.selectExpr("CAST(conv_id AS BIGINT) AS conv_id", "coalesce(CAST(conv_id AS STRING), ' ') AS c", "CAST(turn AS BIGINT) AS turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text")
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    initial = F.substring("role", 1, 1)
    ended = F.rtrim(F.col("text"), F.lit(_SPACE))
    out = plain.withColumn("pos", F.row_number().over(order).cast("long") - 1).withColumn("initial", initial).withColumn("pair", F.concat(F.lag(initial).over(order), initial))
    out = out.withColumn("new_turn", F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(order) == F.col("turn"), F.lit(False)))
    seen = F.row_number().over(Window.partitionBy("c", "role", "text").orderBy("pos")) > 1
    fault = F.when(ended == "", "blank").when(seen, "duplicate").when(~F.substring(ended, -1, 1).isin(".", "!", "?"), "truncated")
    return out.withColumn("fault", fault).withColumn("block", F.expr(f"pos DIV {block}"))


def edits(rows: DataFrame, ws: Workspace, block: int = BLOCK) -> DataFrame:
    """numbered rows with edit: the letters of what is inserted before a row, of the row itself, and of what follows the last."""
    small = rows.selectExpr("c", "block", "pos", "initial", "coalesce(fault IN ('blank', 'duplicate'), false) AS must", "CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut")
    by_block = lambda t: t.repartition("c", "block").sortWithinPartitions("c", "block", "pos")
    through = by_block(small).mapInArrow(_through, "c string, block long, through array<long>")
    togo = through.repartition("c").sortWithinPartitions("c", F.desc("block")).mapInArrow(_togo, "c string, block long, togo array<long>, last boolean")
    walks = by_block(small.join(ws.put("togo", togo), ["c", "block"])).mapInArrow(_walks, "c string, block long, codes array<string>, ends array<long>, last boolean")
    chosen = walks.repartition("c").sortWithinPartitions("c", "block").mapInArrow(_chosen, "c string, block long, code string, tail string")
    each = chosen.selectExpr("c", "block", "tail", "regexp_extract_all(code, '[ua]*[DKUA]', 0) AS parts").selectExpr("c", "block", "size(parts) AS n", "tail", "posexplode(parts) AS (i, edit)")
    each = each.selectExpr("c", f"block * {block} + i AS pos", "CASE WHEN i = n - 1 THEN concat(edit, tail) ELSE edit END AS edit")
    return rows.join(ws.put("edits", each), ["c", "pos"])


def repaired(edited: DataFrame) -> DataFrame:
    """(conv_id, place, part, role, text): the repaired conversations; place and part give the order."""
    kept = edited.selectExpr("conv_id", "pos AS place", "role", "text", "posexplode(split(edit, '')) AS (part, x)").where("x <> 'D' AND x <> ''")
    return kept.selectExpr("conv_id", "place", "part", "CASE WHEN x = 'K' THEN role WHEN x IN ('u', 'U') THEN 'user' ELSE 'assistant' END AS role", "CASE WHEN x IN ('u', 'a') THEN '' ELSE text END AS text")


def report(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """conversations -> (one row a conversation with faults, audit and digest; the repaired rows)."""
    spark = rows.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "repair")
    own = ws.put("rows", numbered(rows, block))
    edited = edits(own, ws, block)
    count = lambda x: F.count_if(F.expr(x)).alias
    faults = own.groupBy("c").agg(
        F.max("conv_id").alias("conv_id"),
        F.expr("coalesce(max(turn) - min(turn) + 1 - count_if(new_turn), 0)").alias("gaps"),
        *[count(f"fault = '{x}'")(x) for x in ("blank", "duplicate", "truncated")],
        count("pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')")("illegal"),
    )
    texts = edited.selectExpr("c", "pos", "role", "text", "edit", "CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut")
    digests = texts.repartition("c").sortWithinPartitions("c", "pos").mapInArrow(_digests, "c string, audit string, cost long, repaired_sha256 string")
    return faults.join(digests, "c").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), repaired(edited)


def damage(rows: DataFrame) -> DataFrame:
    """Faults to repair: by crc32 of ``conv_id:turn`` a twentieth each is dropped, emptied, loses its ends of sentences, is repeated, or is given to the user."""
    text = rows.selectExpr("conv_id", "turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text", "crc32(concat(coalesce(CAST(conv_id AS STRING), ' '), ':', coalesce(CAST(turn AS STRING), ' '))) % 20 AS x").where("x <> 0")
    return text.selectExpr("conv_id", "turn", "CASE WHEN x = 4 THEN 'user' ELSE role END AS role", "CASE WHEN x = 1 THEN '' WHEN x = 2 THEN translate(text, '.!?', '') ELSE text END AS text", "explode(CASE WHEN x = 3 THEN array(0, 1) ELSE array(0) END) AS copy").drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = report(damage(rows))[0].withColumnRenamed("conv_id", "own")
    every = rows.selectExpr("CAST(conv_id AS BIGINT) AS conv_id").distinct()
    counts = [f"coalesce({x}, 0L) AS {x}" for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left").selectExpr("conv_id", *counts, "coalesce(audit, '') AS audit", "coalesce(repaired_sha256, sha2('', 256)) AS repaired_sha256")


QUERIES = {"op12_conversation_repair": query}
