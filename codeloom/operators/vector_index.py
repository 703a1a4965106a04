"""Nearest neighbours without comparing every vector, and with the same answer.

Vectors lie in cells, a folder each, by the nearest of at most ``MOST_CELLS`` centroids, which are fitted on at most
``SAMPLE`` rows; every row is in a cell. A row keeps its distance to the centroid (its reach), and a code: the
offset from the centroid in a byte per dimension, with the exact length of what that leaves out. So a code gives
a lower and an upper bound of a distance, in a quarter of a vector's bytes.

A query opens first the nearest cells, whose k-th upper bound is a limit for the answer. By the triangle inequality
it is done with a cell whose distance less its radius is beyond the limit, and with a row whose reach differs more than
that from the query's distance to the centroid. The codes of what remains lower the limit; only rows whose
lower bound is within it are compared as full vectors. Where vectors have no clusters the cells rule out little, and the
codes do the work.

An upsert writes its rows and leaves the rest; centroids stay until the next ``build``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.vectors import cosine, euclidean, literal
from codeloom.sources.layers import Layered
from codeloom.sources.shared_files import delete
from codeloom.sources.staging import new_path

SAMPLE, MOST_CELLS = 8_192, 1_024
#: Rounds of fitting the centroids.
ROUNDS = 8
#: Candidates up to which their keys go into the scan's filter; more are joined.
FILTERED = 1_000
#: What rounding may do to a distance in double precision, as a share of it.
EPSILON = 1e-9


@dataclass
class Counts:
    """What a search read: cells opened of all, rows of all, codes looked at, and full vectors compared."""

    cells: int = 0
    opened: int = 0
    rows: int = 0
    coded: int = 0
    compared: int = 0


def usable(vector: str, dimensions: int) -> Column:
    v = F.col(vector)
    return F.coalesce((F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _nearest(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(1) - 2 * m @ centroids.T).argmin(1)


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of ``sample`` by a few rounds of k-means; rows in a fixed order start them."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        cell = _nearest(sample, centroids)
        n, total = np.bincount(cell, minlength=cells), np.zeros_like(centroids)
        np.add.at(total, cell, sample)
        centroids[n > 0] = total[n > 0] / n[n > 0, None]
    return centroids


def encode(m: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell, reach, step, slack, code) of each row of ``m``."""
    cell = _nearest(m, centroids)
    offset = m - centroids[cell]
    reach = np.sqrt((offset * offset).sum(1))
    step = np.maximum(np.abs(offset).max(1, initial=0), np.finfo(float).tiny) / 127
    code = np.rint(offset / step[:, None]).astype(np.int8)
    rest = offset - code * step[:, None]
    return cell, reach, step, np.sqrt((rest * rest).sum(1)), code


class VectorIndex:
    """Vectors of ``dimensions`` numbers below ``folder``, by ``key``; the metric is ``l2`` or ``cosine``."""

    def __init__(self, spark: SparkSession, folder: str, dimensions: int, metric: str = "l2", key: str = "node_id", vector: str = "vector"):
        if metric not in ("l2", "cosine"):
            raise ValueError(f"no such metric: {metric}")
        self.spark, self.dimensions, self.metric, self.key, self.vector = spark, dimensions, metric, key, vector
        self.rows = Layered(spark, f"{folder}/rows", [key], F.col("cell"))
        self.cells = Layered(spark, f"{folder}/cells", ["cell"], F.lit(0))

    def exists(self) -> bool:
        return self.cells.exists()

    # ---- writing --------------------------------------------------------------------------------

    def _coded(self, vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
        width, unit, key_type = self.dimensions, self.metric == "cosine", vectors.schema[self.key].dataType.simpleString()
        shared = self.spark.sparkContext.broadcast(centroids)  # MOST_CELLS rows at most

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = _matrix(batch.column(1), width)
                keep = pa.array((m != 0).any(1)) if unit else None  # a zero vector has no direction
                if unit:
                    batch, m = batch.filter(keep), _unit(m[keep.to_numpy(zero_copy_only=False)])
                cell, reach, step, slack, code = encode(m, shared.value)
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(cell.astype(np.int32)), pa.array(reach), pa.array(step), pa.array(slack), codes, batch.column(1)], names=["key", "cell", "reach", "step", "slack", "code", "vector"]
                )

        chosen = vectors.where(usable(self.vector, width)).select(F.col(self.key), F.col(self.vector).cast("array<float>"))
        out = chosen.mapInArrow(run, f"key {key_type}, cell int, reach double, step double, slack double, code binary, vector array<float>")
        return out.withColumnsRenamed({"key": self.key, "vector": self.vector})

    def _measured(self, rows: DataFrame, centroids: DataFrame) -> DataFrame:
        sizes = rows.groupBy("cell").agg(F.max("reach").alias("radius"), F.count("*").alias("n"))
        return centroids.join(sizes, "cell", "left").select("cell", "centroid", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("n", F.lit(0)).alias("n"))

    def build(self, vectors: DataFrame) -> None:
        """Index ``vectors`` (key, vector) in place of all that was; rows of another length or with null or
        non-finite numbers have no distance and are left out."""
        good = vectors.where(usable(self.vector, self.dimensions))
        n = good.count()
        some = good.orderBy(F.xxhash64(self.key), self.key).limit(SAMPLE).select(F.col(self.vector).cast("array<double>").alias("v")).toArrow()
        m = _matrix(some.column(0).combine_chunks(), self.dimensions) if len(some) else np.zeros((1, self.dimensions))
        m = _unit(m) if self.metric == "cosine" else m
        centroids = fit(m, max(1, min(MOST_CELLS, math.isqrt(n), len(m))))
        table = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        number = self.rows.write(self._coded(vectors, centroids))
        self.cells.write(self._measured(self.rows.read(number=number), table), of=number)

    def upsert(self, vectors: DataFrame, gone: DataFrame | None = None) -> None:
        """``vectors`` in place of those with the same key, and the keys of ``gone`` away."""
        if not self.exists():
            return self.build(vectors)
        since = self.cells.meta("of")
        ids, centroids, _, _ = self._cells()
        keys = vectors.select(self.key) if gone is None else vectors.select(self.key).unionByName(gone.select(self.key))
        number = self.rows.change(self._coded(vectors, centroids), keys, since)
        table = self.spark.createDataFrame([(int(i), c.tolist()) for i, c in zip(ids, centroids)], "cell int, centroid array<double>")
        # radii and counts need two narrow columns of the rows
        self.cells.write(self._measured(self.rows.read(number=number).select("cell", "reach"), table), of=number)

    # ---- searching ------------------------------------------------------------------------------

    def _cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        found = self.cells.read().orderBy("cell").collect()  # MOST_CELLS rows at most
        return np.array([r.cell for r in found]), np.array([r.centroid for r in found], float), np.array([r.radius for r in found]), np.array([r.n for r in found])

    def _bounds(self, rows: DataFrame, query: np.ndarray, centroids: np.ndarray, k: int, limit: float) -> DataFrame:
        """(key, cell, lower, upper) of rows that may be among the k nearest, as far as a task knows; each looks at its own codes only."""
        to = np.sqrt(((centroids - query) ** 2).sum(1))
        shared = self.spark.sparkContext.broadcast((query, centroids, to))

        def run(batches):
            q, c, away = shared.value
            best = np.full(k, limit)
            for batch in batches:
                cell, reach, step, slack = (batch.column(i).to_numpy() for i in (1, 2, 3, 4))
                keep = np.flatnonzero(np.abs(away[cell] - reach) <= best.max() * (1 + EPSILON) + EPSILON)
                code = np.frombuffer(b"".join(batch.column(5).take(pa.array(keep)).to_pylist()), np.int8).reshape(len(keep), c.shape[1])
                cell, step, slack = cell[keep], step[keep], slack[keep]
                off = (q - c[cell]) - code * step[:, None]
                d = np.sqrt((off * off).sum(1))
                lower, upper = d - slack - EPSILON * (1 + d), d + slack + EPSILON * (1 + d)
                best = np.partition(np.concatenate([best, upper]), k - 1)[:k]
                near = np.flatnonzero(lower <= best.max())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep[near])), pa.array(cell[near]), pa.array(lower[near]), pa.array(upper[near])], names=["key", "cell", "lower", "upper"])

        key_type = rows.schema[self.key].dataType.simpleString()
        return rows.select(self.key, "cell", "reach", "step", "slack", "code").mapInArrow(run, f"key {key_type}, cell int, lower double, upper double")

    def search(self, query: list[float], k: int) -> tuple[DataFrame, Counts]:
        """What ``vectors.knn`` gives for ``k`` rows, and what was read for it: key and vector, with distance and
        score by l2, or the score by cosine where it is positive."""
        ids, centroids, radius, n = self._cells()
        number = self.cells.meta("of")
        counts = Counts(len(ids), 0, int(n.sum()))
        q = np.array(query, float)
        empty = self.rows.read(buckets=[], number=number).select(self.key, self.vector)
        scored = F.col(self.vector), literal(query)
        final = (lambda d: d.withColumn("score", cosine(*scored)).where("score > 0").orderBy(F.desc("score"), self.key).limit(k)) if self.metric == "cosine" else (
            lambda d: d.withColumn("distance", euclidean(*scored)).withColumn("score", 1 / (1 + F.col("distance"))).orderBy("distance", self.key).limit(k)
        )
        if len(q) != self.dimensions or k < 1 or self.metric == "cosine" and not q.any():
            return final(empty), counts
        q = _unit(q[None, :])[0] if self.metric == "cosine" else q
        away = np.sqrt(((centroids - q) ** 2).sum(1))
        order = np.argsort(away)
        first = order[: int(np.searchsorted(np.cumsum(n[order]), k)) + 1]
        limit = math.inf
        if n[first].sum() >= k:
            probe = self._bounds(self.rows.read(ids[first].tolist(), number=number), q, centroids, k, math.inf)
            uppers = [r.upper for r in probe.select("upper").orderBy("upper").limit(k).collect()]  # k numbers
            limit = uppers[-1] if len(uppers) == k else math.inf
        opened = np.flatnonzero((away - radius <= limit * (1 + EPSILON) + EPSILON) & (n > 0))
        counts.opened, counts.coded = len(opened), int(n[opened].sum())
        path = new_path(self.spark, "near")
        bounds = self._bounds(self.rows.read(ids[opened].tolist(), number=number), q, centroids, k, limit)
        bounds.write.parquet(path)
        near = self.spark.read.schema(bounds.schema).parquet(path)
        kth = near.orderBy("upper").limit(k).agg(F.max("upper").alias("t"), F.count("*").alias("n")).first()
        chosen = near.where(F.col("lower") <= (kth.t if kth.n == k else math.inf))
        counts.compared = chosen.count()
        held = [r.cell for r in chosen.select("cell").distinct().collect()]
        full = self.rows.read(held, number=number).select(self.key, self.vector)
        if counts.compared <= FILTERED:
            keys = [r.key for r in chosen.select("key").collect()]
            delete(self.spark, path)
            return final(full.where(F.col(self.key).isin(keys)) if keys else empty), counts
        return final(full.join(chosen.select(F.col("key").alias(self.key)), self.key, "left_semi")), counts
