"""Ball k-means over integer vectors: a round compares a vector only with the centroids that could be nearer than its own.

A cluster is a ball: its centroid and the farthest of its members. Centroid j is a neighbour of i if the point halfway between them lies within i's
ball. Members nearer to their centroid than half the way to the nearest neighbour form the stable core and stay, compared with nothing else. The others lie in
annuli: those beyond halfway to the m-th neighbour, but not to the next, are compared exactly with the first m. A task does this for the members that
are in a batch of its rows, so the ball is that of the members at hand, no larger than the whole one. Everything is exact: components are integers,
distances are squared and kept in 64 bits, and "halfway" includes the tie, so that the smaller number of equally near centroids wins.

A round is one pass over the vectors, with their clusters written to the shared folder and read again, and one aggregate of sums, which are combined in
each task. Only the centroids (k rows) go to the driver and, as a broadcast, to the tasks.

Cases: vectors that are null, of another length, or hold null or non-finite components take no part; integers beyond 2^27 in size are
clipped there, so that a distance fits 64 bits; a null vec_id is clustered but its vector starts a centroid only where too few others are left; repeated
rows are vectors of their own, and equal ones may start two centroids, the second of which then stays empty; with fewer vectors than k there are
as many centroids as vectors; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm._store import Workspace

#: Largest size of an integer component.
MOST = 1 << 27


def whole_numbers(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of full length and finite components as integers floor(scale * x)."""
    fit = f"size(embedding) = {dims} AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"
    whole = f"transform(embedding, x -> CAST(greatest({-MOST}e0, least({MOST}e0, floor({scale}e0 * CAST(x AS DOUBLE)))) AS INT))"
    return rows.where(f"coalesce({fit}, false)").selectExpr("CAST(vec_id AS BIGINT) AS vec_id", f"{whole} AS v")


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors whose ids have the least hashes, k at most."""
    first = vectors.selectExpr(f"sha2(concat('{salt}:', vec_id), 256) AS h", "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centre of each vector, of all centres."""
    best, least = np.zeros(len(v), np.int64), np.full(len(v), np.iinfo(np.int64).max)
    for j, c in enumerate(centres):
        d = ((v - c) ** 2).sum(axis=1)
        less = d < least
        best[less], least[less] = j, d[less]
    return best, least


def reassign(v: np.ndarray, cluster: np.ndarray, centres: np.ndarray, count=None) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest``, for vectors that have a cluster already: by balls, neighbours, cores and annuli. ``count`` gets the number of comparisons."""
    best, least = cluster.copy(), np.zeros(len(v), np.int64)
    order = np.argsort(cluster, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1) if len(v) else ():
        i = int(cluster[rows[0]])
        own = ((v[rows] - centres[i]) ** 2).sum(axis=1)
        apart = ((centres - centres[i]) ** 2).sum(axis=1)
        # halfway within the ball: apart / 2 <= radius, in squares
        near = np.flatnonzero(apart <= 4 * own.max()) if own.max() < 1 << 61 else np.arange(len(centres))
        near = near[near != i]
        near = near[np.argsort(apart[near], kind="stable")]
        annulus = np.searchsorted(apart[near], 4 * own if own.max() < 1 << 61 else np.full(len(own), np.iinfo(np.int64).max), "right")
        number, closest = np.full(len(rows), i), own.copy()
        for m, j in enumerate(near):
            beyond = np.flatnonzero(annulus > m)
            d = ((v[rows[beyond]] - centres[j]) ** 2).sum(axis=1)
            better = (d < closest[beyond]) | (d == closest[beyond]) & (j < number[beyond])
            number[beyond[better]], closest[beyond[better]] = j, d[better]
            if count is not None:
                count.append(len(beyond))
        best[rows], least[rows] = number, closest
    return best, least


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _assigned(shared):
    def run(batches):
        centres = shared.value
        for batch in batches:
            v = _matrix(batch.column("v"), centres.shape[1])
            old = batch.column("cluster")
            found = nearest(v, centres) if old.null_count else reassign(v, old.to_numpy().astype(np.int64), centres)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(found[0].astype(np.int32)), pa.array(found[1])],
                names=["vec_id", "v", "cluster", "distance"],
            )

    return run


def _sums(k: int, dims: int):
    def run(batches):
        total, n = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for batch in batches:
            v, cluster = _matrix(batch.column("v"), dims), batch.column("cluster").to_numpy()
            part = np.zeros((k, dims), np.int64)
            np.add.at(part, cluster, v)
            total += part
            n += np.bincount(cluster, minlength=k)
        c, i = np.nonzero(np.broadcast_to(n[:, None] > 0, (k, dims)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array([int(x) for x in total[c, i]], pa.decimal128(38)), pa.array(n[c])],
            names=["cluster", "i", "total", "n"],
        )

    return run


def moved(assigned: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centroids at the floor of their vectors' mean, component by component; those without vectors stay."""
    sums = assigned.select("v", "cluster").mapInArrow(_sums(*centres.shape), "cluster int, i int, total decimal(38,0), n long")
    out = centres.copy()
    for r in sums.groupBy("cluster", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k times dims rows
        out[r["cluster"], r["i"]] = int(r["total"]) // r["n"]
    return out


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2") -> tuple[DataFrame, np.ndarray]:
    """rows (vec_id, embedding): (vec_id, v, cluster, distance) after so many rounds, and the centroids."""
    spark = rows.sparkSession
    ws, schema = Workspace(spark, "balls"), "vec_id long, v array<int>, cluster int, distance long"
    now = ws.put("0", whole_numbers(rows, dims, scale).selectExpr("*", "CAST(NULL AS INT) AS cluster"))
    centres = seeds(now, k, salt)
    if not len(centres):
        return now.selectExpr("*", "0L AS distance"), centres
    for i in range(rounds + 1):
        shared = spark.sparkContext.broadcast(centres)
        now = ws.put(str(i + 1), now.select("vec_id", "v", "cluster").mapInArrow(_assigned(shared), schema))
        ws.drop(str(i))
        shared.unpersist()
        if i < rounds:
            centres = moved(now, centres)
    return now, centres


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centres = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    names = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centres.tolist())], "cluster int, components string")  # k rows
    top = "CAST(least({}, 9223372036854775807BD) AS BIGINT)"
    own = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("own"))
    own = own.selectExpr("cluster", f"{top.format('own')} AS cluster_inertia", f"{top.format('sum(own) OVER ()')} AS inertia")  # k rows
    both = own.join(names, "cluster").selectExpr("cluster", "cluster_inertia", "inertia", "sha2(components, 256) AS centroid_sha256")
    return found.select("vec_id", "cluster", "distance").join(F.broadcast(both), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2") -> str:
    """The same by comparing every vector with every centroid in every round."""
    fit = f"len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {fit})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c FROM (SELECT sha256(concat('{salt}:', vec_id)) AS h, v FROM v ORDER BY h, v LIMIT {k}))",
    ]
    apart = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(d) AS distance, arg_min(cluster, (d, cluster)) AS cluster FROM (SELECT vec_id, v, cluster, CAST({apart} AS BIGINT) AS d FROM v CROSS JOIN c{i}) GROUP BY vec_id)")
        if i < rounds:
            steps += [
                f"s{i} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{i}) GROUP BY cluster, i)",
                f"m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS m FROM s{i} GROUP BY cluster)",
                f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m, c) AS c FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.cluster)",
            ]
    last = f"a{rounds}"
    return f"""WITH {', '.join(steps)} SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
      CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM {last} a JOIN c{rounds} c ON c.cluster = a.cluster"""


QUERIES = {"op13_centroid_clustering": query}
ORACLES = {"op13_centroid_clustering": oracle}
