"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

Every vector is divided by its norm and rotated by a random orthogonal matrix; its code is the signs of the rotated coordinates, packed to
bits. One correction scalar is kept with it: <o, c>, the inner product of the rotated vector with its own unit code. For a query q (rotated, in full),
<q, c> / <o, c> estimates the cosine, and its error is under eps * sqrt((1 - <o, c>^2) / <o, c>^2 / (d - 1)) but for a chance that falls with exp(-eps^2 / 2).

The rows are scanned once, in Arrow batches, against each block of at most ``QUERY_BLOCK`` queries (a broadcast of bounded size). Per task and query the
k-th best lower bound so far decides which vectors' upper bounds make them worth reranking by their exact cosine in double precision; a task emits
its k best, and the k best of all tasks are ranked by a window over those few rows. All rows are coded; nothing is fitted on a sample.

The work is queries times rows; the estimate costs a table look-up for eight dimensions of a pair.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as query or row; so do vectors of another length than
the query's (they are compared within their own length); a null id takes no part; ties go to the smaller id. Repeated rows: an id is in a
query's result once, with its best score; of different vectors under one id each counts as a row, and the least of them (component by
component) is the query. Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries that are broadcast at a time: 64 dimensions make 5 MB of them.
QUERY_BLOCK = 10_000
#: Vectors that a task codes and compares at a time.
ROWS_AT_ONCE = 8192
#: Chance of a miss by one comparison: about exp(-EPS ** 2 / 2).
EPS = 3.0


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


class Codes:
    """Unit vectors as packed signs with the correction scalar and the error bound of each."""

    def __init__(self, unit: np.ndarray, turn: np.ndarray):
        """unit: rows of length 1; turn: a rotation."""
        d = unit.shape[1]
        turned = unit @ turn
        signs = turned >= 0
        self.bits = np.packbits(signs, axis=1)
        self.scale = np.maximum(np.abs(turned).sum(axis=1) / np.sqrt(d), 1e-9)
        self.bound = EPS * np.sqrt(np.maximum(0, 1 - self.scale**2) / self.scale**2 / max(1, d - 1))


def estimates(turned_query: np.ndarray, codes: Codes) -> np.ndarray:
    """Estimated inner products of one rotated query with all codes: its coordinates are looked up by byte, eight signs at a time."""
    d = len(turned_query)
    q = np.zeros(codes.bits.shape[1] * 8)
    q[:d] = turned_query
    q = q.reshape(-1, 8)
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1
    table = (q @ signs.T).astype(np.float32)
    total = np.zeros(len(codes.bits), np.float32)
    for i in range(len(table)):
        total += table[i][codes.bits[:, i]]
    return total / np.sqrt(d) / codes.scale


def cosine(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """In double precision, on the original vectors; each row summed in the same order whatever the others are."""
    return (rows * q).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((q * q).sum()))


def vectors(ids: pa.Array, column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and vectors (double) of the rows that take part."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten()
    if len(size) and (size == size[0]).all() and size[0] and not (column.null_count or ids.null_count or flat.null_count):
        x = flat.to_numpy(zero_copy_only=False).reshape(-1, int(size[0])).astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            norm = (x * x).sum(axis=1)
        ok = np.isfinite(x).all(axis=1) & np.isfinite(norm) & (norm > 0)
        return {int(size[0]): (ids.to_numpy()[ok].astype(np.int64), x[ok])} if ok.any() else {}
    out: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids.to_pylist(), column.to_pylist(), strict=True):
        if i is None or not v or None in v:
            continue
        x = np.array(v, np.float64)
        if np.isfinite(x).all() and (x != 0).any() and np.isfinite((x * x).sum()) and (x * x).sum() > 0:
            a, b = out.setdefault(len(x), ([], []))
            a.append(i)
            b.append(x)
    return {d: (np.array(a, np.int64), np.stack(b)) for d, (a, b) in out.items()}


def _once(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without those that have both id and vector of another: the k best are to be k ids."""
    order = np.argsort(ids, kind="stable")
    if not len(ids) or (np.diff(ids[order]) > 0).all():
        return ids, x
    whole = np.column_stack([ids.view(np.float64), x])
    _, first = np.unique(np.ascontiguousarray(whole).view(f"V{8 * whole.shape[1]}").ravel(), return_index=True)
    return ids[np.sort(first)], x[np.sort(first)]


def _gathered(batches):
    """Arrow batches put together to tables of some thousand rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= ROWS_AT_ONCE:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _search(shared, k: int):
    def run(batches):
        queries = shared.value
        best: dict[tuple[int, int], list[tuple[float, int]]] = {}
        turns = {d: rotation(d) for d in queries}
        turned = {d: (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ turns[d] for d, (_, x) in queries.items()}
        for table in _gathered(batches):
            for d, (ids, x) in vectors(table.column("id").combine_chunks(), table.column("v").combine_chunks()).items():
                if d not in queries:
                    continue
                ids, x = _once(ids, x)
                _, number = np.unique(ids, return_inverse=True)
                alike = len(number) and number.max() + 1 < len(ids)  # different vectors under one id
                codes = Codes(x / np.sqrt((x * x).sum(axis=1))[:, None], turns[d])
                for n, q in enumerate(queries[d][0].tolist()):
                    near = estimates(turned[d][n], codes)
                    own = ids != q
                    held = best.get((d, n), [])
                    low = np.where(own, near - codes.bound, -np.inf)
                    if alike:
                        each, low = low, np.full(number.max() + 1, -np.inf)
                        np.maximum.at(low, number, each)
                    least = np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf
                    if len(held) == k:
                        least = max(least, -held[-1][0])
                    some = np.flatnonzero(own & (near + codes.bound >= least - 1e-6))
                    if len(some):
                        exact = cosine(queries[d][1][n], x[some])
                        merged: dict[int, float] = {}
                        for score, i in sorted([*held, *zip((-exact).tolist(), ids[some].tolist(), strict=True)]):
                            merged.setdefault(i, score)
                            if len(merged) == k:
                                break
                        best[d, n] = [(score, i) for i, score in merged.items()]
        rows = [(int(queries[d][0][n]), i, -s) for (d, n), held in best.items() for s, i in held]
        yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], ["query_id", "id", "score"])

    return run


_USABLE = "id IS NOT NULL AND size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('inf')) AND exists(v, c -> c <> 0)"


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """rows, queries (id, v: array of numbers): query_id, rank, id, score of each query's k nearest rows by cosine, its own id left out."""
    spark = rows.sparkSession
    cast = lambda t: t.selectExpr("CAST(id AS BIGINT) AS id", "CAST(v AS ARRAY<DOUBLE>) AS v").where(_USABLE)
    rows, queries = cast(rows), cast(queries).groupBy("id").agg(F.min("v").alias("v"))
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    found = None
    for b in range(blocks):
        part = (queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else queries).toArrow()
        shared = spark.sparkContext.broadcast(vectors(part.column("id").combine_chunks(), part.column("v").combine_chunks()))
        some = rows.mapInArrow(_search(shared, k), "query_id long, id long, score double")
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS v")
    return nearest(rows, rows.where("id % 50 = 0")).withColumnRenamed("id", "vec_id")


QUERIES = {"op3_nearest_neighbours": op3_nearest_neighbours}
