"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, with multiprobe.

A table's hash of a vector is the nearest vertex of the cross-polytope (which coordinate is largest in
magnitude, and its sign) after three rounds of random signs and a fast Hadamard transform. A vector
enters its own bucket of each table and, as a visitor, the buckets of its next best vertices. Within
buckets all pairs are compared by exact cosine in blocks: large buckets are cut into blocks of
``BLOCK`` rows and every pair of blocks is a group of its own, so no task holds a bucket and no pair is
ever a row. A pair counts in the first bucket that it meets in, which both rows' hashes tell, so links
are counted once; what leaves a group is a partial count and a spanning link per row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import connected_components, discard, stage

#: Tables, vertices that make up a hash, and visited buckets besides a vector's own. Of random pairs of
#: 64 dimensions at cosine 0.9 a table joins 44 %, so eight tables miss 0.9 % of them; at 0.95, none of 3,000.
TABLES, VERTICES, VISITS = 8, 3, 3
BLOCK = 512
#: Groups up to this size are compared many at a time.
SMALL = 48


class CrossPolytope:
    """Rotations of one width, made from a seed."""

    def __init__(self, width: int, tables: int = TABLES, vertices: int = VERTICES, visits: int = VISITS, seed: int = 11):
        self.size = 1 << max(1, (width - 1).bit_length())
        self.tables, self.vertices, self.visits = tables, vertices, visits
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, vertices, 3, self.size))

    def rotate(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, self.size - x.shape[1])))
        for s in signs:
            x = x * s
            h = 1
            while h < self.size:
                x = x.reshape(len(x), -1, 2, h)
                x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), self.size)
                h *= 2
        return x

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + visits) buckets: a row's own first, then the ones it visits."""
        n, base = len(x), 2 * self.size
        out = np.zeros((n, self.tables, 1 + self.visits), np.int64)
        r = np.arange(n)
        for t in range(self.tables):
            first, second, loss = [], [], []
            for v in range(self.vertices):
                y = self.rotate(x, self.signs[t, v])
                top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
                value = np.abs(np.take_along_axis(y, top, 1))
                swap = value[:, 0] < value[:, 1]
                top[swap], value[swap] = top[swap, ::-1], value[swap, ::-1]
                code = top * 2 + (np.take_along_axis(y, top, 1) < 0)
                first.append(code[:, 0])
                second.append(code[:, 1])
                loss.append(value[:, 0] ** 2 - value[:, 1] ** 2)
            # the next buckets change the vertices that lose least: any set of them, cheapest first
            ways = np.array([[m >> v & 1 for v in range(self.vertices)] for m in range(1 << self.vertices)], bool)
            cost = np.stack(loss, 1) @ ways.T
            order = np.argsort(cost, 1, kind="stable")[:, : 1 + self.visits]
            for p in range(1 + self.visits):
                way = ways[order[:, min(p, order.shape[1] - 1)]]
                code = np.zeros(n, np.int64)
                for v in range(self.vertices):
                    code = code * base + np.where(way[r, v], second[v], first[v])
                out[:, t, p] = code
        return out


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (vec_id, rep) of equal vectors, and representatives (rep, copies, v: unit vector)."""
    parts = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, b: a + b * b))
    unit = (
        vectors.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("x"))
        .withColumn("norm", norm)
        .where("norm > 0")
    )
    keyed = stage(unit.groupBy("vec_id").agg(F.min(F.struct("x", "norm")).alias("r")).select("vec_id", "r.*").withColumn("key", F.sha2(F.concat_ws(",", "x"), 256)), "embed")
    same = keyed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    members = keyed.select("vec_id", "key").join(same, "key").select("vec_id", "rep", "copies")
    reps = keyed.join(same.select(F.col("rep").alias("vec_id"), "copies"), "vec_id").select(
        F.col("vec_id").alias("rep"), "copies", F.transform("x", lambda a: a / F.col("norm")).alias("v")
    )
    return members, reps


def _pairs(start: np.ndarray, size: np.ndarray, x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within each group (rows start .. start + size) with cosine >= ``cosine``."""
    left, right = [], []
    for m in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
        begin = start[size == m]
        a, b = np.triu_indices(m, 1)
        step = max(1, 200_000 // len(a))
        for at in range(0, len(begin), step):
            left.append((begin[at : at + step, None] + a).ravel())
            right.append((begin[at : at + step, None] + b).ravel())
            near = np.einsum("ij,ij->i", x[left[-1]], x[right[-1]]) >= cosine
            left[-1], right[-1] = left[-1][near], right[-1][near]
    for s, m in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        y = x[s : s + m]
        for at in range(0, m, BLOCK):
            a, b = np.nonzero(y[at : at + BLOCK] @ y.T >= cosine - 1e-9)
            a, b = a[a + at < b] + at + s, b[a + at < b] + s
            sure = np.einsum("ij,ij->i", x[a], x[b]) >= cosine  # one order of summation for every pair
            left.append(a[sure])
            right.append(b[sure])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]).astype(np.int64), np.concatenate([none, *right]).astype(np.int64)


def _compare(pdf: pd.DataFrame, tables: int, cosine: float) -> pd.DataFrame:
    """Links of whole groups: per row and group the linked vectors (copies too), and the smallest row
    that it is connected with in the group."""
    key = pdf[["bucket", "i", "j"]].to_numpy()
    start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
    size = np.diff(np.append(start, len(pdf)))
    ids, copies, block = pdf.rep.to_numpy(np.int64), pdf.copies.to_numpy(np.int64), pdf.block.to_numpy()
    width = pdf.v.map(len).to_numpy()
    x = np.zeros((len(pdf), int(width.max())))
    for w in np.unique(width).tolist():  # one bucket holds vectors of one length
        x[width == w, :w] = np.stack(pdf.v[width == w].to_numpy())
    codes = np.stack(pdf.codes.to_numpy()).reshape(len(pdf), tables, -1)
    a, b = _pairs(start, size, x, cosine)
    crossed = (key[a, 1] == key[a, 2]) | (block[a] != block[b])  # pairs of one block belong to that block alone
    a, b = a[crossed], b[crossed]
    first = np.full(len(a), np.iinfo(np.int64).max)
    open_ = np.ones(len(a), bool)
    for t in range(tables):  # the bucket that the pair meets in first
        some = np.flatnonzero(open_)
        both = np.where((codes[a[some], t, :, None] == codes[b[some], t, None, :]).any(2), codes[a[some], t], first[some, None]).min(1)
        first[some] = both
        open_[some] = both == np.iinfo(np.int64).max
    here = first == key[a, 0]
    a, b = a[here], b[here]
    links, label = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    while len(a):
        low = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        if (now == label).all():
            break
        label = now
    some = links > 0
    return pd.DataFrame({"rep": ids[some], "links": links[some], "near": ids[label[some]]})


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, tables: int = TABLES, visits: int = VISITS) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Links are pairs of other vectors with cosine >= ``cosine``, in double precision, that share a
    bucket. Null vectors, zero vectors and vectors with null or non-finite components link with
    nothing, nor do vectors of another length. Equal vectors link with each other, and are hashed
    once. Rows that share a vec_id count once, with the smallest of their vectors. A null vec_id has a null component_id and is kept. Extra
    columns are ignored; an empty table gives no rows.
    """
    members, reps = distinct_vectors(vectors)
    members, reps = stage(members, "embed-members"), stage(reps, "embed-reps")

    def hashed(batches):
        planes: dict[int, CrossPolytope] = {}
        for batch in batches:
            width = np.array([len(x) for x in batch.column(2).to_pylist()]) if batch.num_rows else np.empty(0, int)
            codes = np.zeros((batch.num_rows, tables * (1 + visits)), np.int64)
            for w in np.unique(width).tolist():
                which = np.flatnonzero(width == w)
                x = np.array(batch.column(2).take(pa.array(which)).to_pylist())
                plane = planes.setdefault(w, CrossPolytope(w, tables, VERTICES, visits))
                codes[which] = (plane.codes(x) * tables + np.arange(tables)[:, None]).reshape(len(which), -1) + (np.int64(w) << 44)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(codes), pa.list_(pa.int64()))], names=["rep", "copies", "v", "codes"]
            )

    rows = stage(reps.mapInArrow(hashed, "rep long, copies long, v array<double>, codes array<long>"), "embed-codes")
    entries = rows.select("rep", F.explode(F.array_distinct("codes")).alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    # a row of a large bucket is in one of its blocks; every block meets itself and every other one
    placed = (
        entries.join(sizes, "bucket")
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int"))
    )
    sent = placed.select("rep", "bucket", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "rep", "bucket", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    keys = ["bucket", "i", "j"]
    groups = sent.join(rows.select("rep", "copies", "v", "codes"), "rep").repartition(*keys).sortWithinPartitions(*keys, "rep")

    def compare(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
            whole = int(last.argmax())  # rows of the last group may go on in the next batch
            held = pdf.iloc[whole:]
            if whole:
                yield _compare(pdf.iloc[:whole], tables, cosine)
        if held is not None and len(held):
            yield _compare(held, tables, cosine)

    found = stage(groups.mapInPandas(compare, "rep long, links long, near long"), "embed-links")
    discard(rows, reps)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("rep").alias("u"), F.col("near").alias("v")))
    known = (
        members.join(links, "rep", "left")
        .join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    return (
        ids.join(known, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
