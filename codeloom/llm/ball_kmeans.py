"""Exact k-means by balls: clusters as (centroid, radius), members in a stable core and annuli.

A round looks at each cluster as a ball whose radius bounds its members' distances. Centroids at most twice
the radius away are the ball's neighbours; no other can be nearer to any member. Of the neighbours in
order of their distance, a member at distance d from its own centroid needs only those at most 2 d away:

* members nearer than half way to the first neighbour are the stable core, which is compared with none;
* the others lie in annuli, and those of the m-th are compared exactly with the first m neighbours.

All of it is whole-number arithmetic, so ties are seen as such. The state of a round is a staged table of
vectors with their cluster; what travels to the driver are a cluster's sums, count and radius, and
what is broadcast are the centroids and neighbour lists: numbers of clusters times dimensions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import discard, stage

#: Whole components lie below this in magnitude, so that four times a squared distance over 64 of them fits in 64 bits.
LARGEST = 1 << 26
#: Vectors that one task holds at once.
TILE = 8_192


@dataclass
class Balls:
    """Centroids, and for each ball its neighbours in order of distance, as indices and squared distances."""

    centroids: np.ndarray
    neighbours: list[np.ndarray]
    apart: list[np.ndarray]


def balls(centroids: np.ndarray, radii: list[int | None]) -> Balls:
    """Neighbours of each ball: centroids at most two radii away (None: a ball that has all vectors)."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    near, far = [], []
    for i, radius in enumerate(radii):
        reach = np.iinfo(np.int64).max if radius is None else min(4 * radius * radius, np.iinfo(np.int64).max)
        others = np.flatnonzero((apart[i] <= reach) & (np.arange(len(centroids)) != i))
        order = others[np.argsort(apart[i][others], kind="stable")]
        near.append(order)
        far.append(apart[i][order])
    return Balls(centroids, near, far)


def reassign(vectors: np.ndarray, clusters: np.ndarray, now: Balls) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector, given the cluster whose ball it lies in; ties: the smaller number."""
    best, least = clusters.copy(), np.empty(len(vectors), np.int64)
    for i in np.unique(clusters).tolist():
        rows = np.flatnonzero(clusters == i)
        own = ((vectors[rows] - now.centroids[i]) ** 2).sum(1)
        least[rows] = own
        # the annulus: how many neighbours are at most twice the member's own distance away
        annulus = np.searchsorted(now.apart[i], 4 * own, side="right")
        for m in range(int(annulus.max(initial=0))):
            outer, j = rows[annulus > m], int(now.neighbours[i][m])
            d = ((vectors[outer] - now.centroids[j]) ** 2).sum(1)
            nearer = (d < least[outer]) | (d == least[outer]) & (j < best[outer])
            best[outer[nearer]], least[outer[nearer]] = j, d[nearer]
    return best, least


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            yield batch.slice(at, TILE)


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def whole_vectors(vectors: DataFrame, width: int, scale: int = 256) -> DataFrame:
    """(vec_id, q) of vectors with exactly ``width`` components, none null or non-finite: floor(scale * x) as int."""
    parts = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    good = (F.size("embedding") == width) & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(parts, lambda x: F.floor(x * scale))
    large = F.exists(whole, lambda x: F.abs(x) >= LARGEST)
    checked = F.when(large, F.raise_error(F.lit(f"a component of {LARGEST // scale} or more has no exact distance"))).otherwise(whole)
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), checked.cast("array<int>").alias("q"))


def starting_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with smallest SHA-256 of ``seed:vec_id``, in that order; vectors of one id by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.where("vec_id is not null").select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64)


def _step(state: DataFrame, now: Balls, width: int) -> DataFrame:
    """``state`` (vec_id, q, cluster) with the new cluster and ``distance``, squared."""
    shared = state.sparkSession.sparkContext.broadcast(now)

    def run(batches):
        for tile in _tiles(batches):
            best, least = reassign(_numbers(tile.column(1), width), tile.column(2).to_numpy().astype(np.int64), shared.value)
            yield pa.RecordBatch.from_arrays([tile.column(0), tile.column(1), pa.array(best.astype(np.int32)), pa.array(least)], names=["vec_id", "q", "cluster", "distance"])

    out = stage(state.select("vec_id", "q", "cluster").mapInArrow(run, "vec_id long, q array<int>, cluster int, distance long"), "balls")
    shared.destroy()
    return out


def _summed(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, componentwise sum, largest squared distance) of each cluster: each task adds up its own first."""

    def run(batches):
        n, total, most = np.zeros(k, np.int64), np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for tile in _tiles(batches):
            cluster, q = tile.column(1).to_numpy().astype(np.int64), _numbers(tile.column(0), width)
            np.add.at(total, cluster, q)
            np.add.at(n, cluster, 1)
            np.maximum.at(most, cluster, tile.column(2).to_numpy())
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(held, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(held))), pa.array(total[held].ravel()), pa.array(np.repeat(n[held], width)), pa.array(np.repeat(most[held], width))],
            names=["cluster", "place", "total", "n", "most"],
        )

    parts = state.select("q", "cluster", "distance").mapInArrow(run, "cluster int, place int, total long, n long, most long")
    rows = parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("most").alias("most")).collect()  # k times width
    n, total, most = np.zeros(k, np.int64), np.zeros((k, width), np.int64), np.zeros(k, np.int64)
    for r in rows:
        n[r.cluster], total[r.cluster, r.place], most[r.cluster] = r.n, r.total, r.most
    return n, total, most


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, width: int = 64) -> DataFrame:
    """Per vector of ``vectors`` (vec_id, embedding): vec_id, cluster, distance (squared), cluster_inertia,
    inertia and centroid_sha256, after ``rounds`` rounds and a last assignment.

    Vectors that are null, of another length, or hold null or non-finite components take no part. A null
    vec_id is assigned but starts no centroid; with none but such, all rows go. Rows that share an id
    are a vector each. Fewer than ``k`` vectors start fewer centroids; an empty table gives no rows.
    Equal distances go to the smaller centroid. Extra columns are ignored. A component of 2**26 or more
    after scaling ends the query, as its distances would not fit in 64 bits.
    """
    spark = vectors.sparkSession
    state = stage(whole_vectors(vectors, width).withColumn("cluster", F.lit(0)), "balls")
    centroids = starting_centroids(state, k, seed)
    k = len(centroids)
    if not k:
        return spark.range(0).selectExpr("id vec_id", "cast(id as int) cluster", "id distance", "id cluster_inertia", "id inertia", "cast(id as string) centroid_sha256")
    radii: list[int | None] = [None] * k
    for _ in range(rounds):
        before, state = state, _step(state, balls(centroids, radii), width)
        discard(before)
        n, total, most = _summed(state, k, width)
        moved = np.where(n[:, None] > 0, np.floor_divide(total, np.maximum(n, 1)[:, None]), centroids)
        shift = ((moved - centroids) ** 2).sum(1)
        # a member is at most its old distance and the centroid's way off the new centroid
        radii = [math.isqrt(int(m)) + math.isqrt(int(s)) + 2 for m, s in zip(most, shift)]
        centroids = moved
    before, state = state, _step(state, balls(centroids, radii), width)
    discard(before)
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")  # k rows
    sums = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    known = sums.join(F.broadcast(named), "cluster")
    inertia = sums.agg(F.sum("cluster_inertia")).scalar()
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", inertia.alias("inertia"), "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, seed: int = 2, width: int = 64) -> str:
    """The same in SQL: every vector against every centroid, a pair of tables for each round."""
    near = """a{r} AS MATERIALIZED (SELECT rid, j, d FROM (
      SELECT v.rid, c.j, list_sum([(v.q[i] - c.q[i]) * (v.q[i] - c.q[i]) for i in range(1, {width} + 1)]) AS d FROM v, c{r} c
    ) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, j) = 1)"""
    mean = """m{r} AS (SELECT a.j, u.i, CAST(floor(sum(v.q[u.i])::DOUBLE / count(*)) AS BIGINT) AS x FROM a{r} a JOIN v USING (rid), (SELECT unnest(range(1, {width} + 1)) AS i) u GROUP BY a.j, u.i),
    g{r} AS (SELECT j, list(x ORDER BY i) AS q FROM m{r} GROUP BY j),
    c{n} AS MATERIALIZED (SELECT c.j, coalesce(g.q, c.q) AS q FROM c{r} c LEFT JOIN g{r} g USING (j))"""
    steps = [near.format(r=r, width=width) + ",\n" + mean.format(r=r, n=r + 1, width=width) for r in range(rounds)]
    return f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings
  WHERE len(embedding) = {width} AND len([x for x in embedding if isfinite(x)]) = {width}
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS INTEGER) AS j, q FROM v WHERE vec_id IS NOT NULL QUALIFY j < {k}
), {", ".join(steps)}, {near.format(r=rounds, width=width)}, s AS (SELECT j, sum(d) AS total FROM a{rounds} GROUP BY j)
SELECT v.vec_id, a.j AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(s.total AS BIGINT) AS cluster_inertia, CAST((SELECT sum(total) FROM s) AS BIGINT) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN s USING (j) JOIN c{rounds} c USING (j)"""
