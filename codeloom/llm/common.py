"""Helpers that several corpus operators share: staged tables, connected components, word hashing.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which every executor can
reach, so a lost executor costs at most the tasks it was running.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.staging import new_path

T = TypeVar("T")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        path = getattr(df, "_staged_at", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_HELD: dict[str, object] = {}


def held_by_worker(token: str, make: Callable[[], T]) -> T:
    """``make()`` once in each Python worker: tasks that it runs later find the result again.

    One result is held at a time, that of the last ``token``, so what an earlier job has left goes.
    """
    if token not in _HELD:
        _HELD.clear()
        _HELD[token] = make()
    return _HELD[token]


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` is in ``gone`` (doc_id); null ids stay, all columns stay."""
    name = fresh(docs.columns, "_gone")
    return docs.join(gone.select(F.col("doc_id").alias(name)).distinct(), F.col("doc_id").cast("long") == F.col(name), "left_anti")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once although ``body`` uses it often or in inner functions."""
    return F.get(F.transform(F.array(value), body), 0)


def chunked_walk(items: Column, state: Column, step: Callable[[Column, Column], Column], kind: str, chunk: int = 512) -> Column:
    """(state, out): ``step(state, item)`` of each of ``items`` gives the next state and an output of type ``kind``.

    An append to an array copies it, so outputs are gathered in chunks: n items copy n * chunk / 2
    entries and n * n / chunk / 2 chunks.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, item: Column) -> Column:
        return let(step(acc.state, item), lambda now: F.struct(now.state.alias("state"), F.concat(acc.out, F.array(now.out)).alias("out")))

    def many(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc.state.alias("state"), none.alias("out")), one)
        return let(inner, lambda now: F.struct(now.state.alias("state"), F.concat(acc.out, F.array(now.out)).alias("out")))

    def walk(all_: Column) -> Column:
        starts = F.when(F.size(all_) > 0, F.sequence(F.lit(1), F.size(all_), F.lit(chunk))).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda at: F.slice(all_, at, chunk))
        start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(parts, start, many, lambda acc: F.struct(acc.state.alias("state"), F.flatten(acc.out).alias("out")))

    return let(items, walk)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def rough_components(edges: DataFrame) -> DataFrame:
    """(node, component) that holds nodes of one component together where they are two steps from the smallest id, and
    never nodes of two: what stars around hubs need. Three aggregates, no rounds."""
    least = _both_ways(edges.select("u", "v")).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    further = least.select(F.col("u").alias("m"), F.col("m").alias("component"))
    return least.join(further, "m").select(F.col("u").alias("node"), "component")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Smallest reachable id of every node that has an edge: columns ``node``, ``component``.

    Alternates the large-star and small-star contractions until the edges stay as they are, which the job
    that writes them observes. A hub's neighbours are never gathered: its minimum is a map-side-combined aggregate that is joined back.
    """

    def written(df: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        return stage(df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("mix")), "cc"), seen.get

    now, mark = written(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct())
    while mark["n"]:
        both = _both_ways(now)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node's own minimum, so that chains fold as well
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select("e.u", F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        before, last = now, mark
        now, mark = written(small)
        discard(before)
        if mark == last:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out._staged_at = now._staged_at
    return out


_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser over an array of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _M3)
_BLOCK = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown by doubling."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = []
        for base in (_BASE, _INVERSE):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            with np.errstate(over="ignore"):
                _POWERS.append(np.multiply.accumulate(out))
    return _POWERS[0], _POWERS[1]


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hash of each word of ``raw``, in order: A-Z lower-cased, words split at 0x20, 0x09-0x0D."""
    if len(raw) > _BLOCK:  # long texts in blocks that end where a word ends, to bound the memory
        b = _SPACE[np.frombuffer(raw, np.uint8)]
        parts, at = [], 0
        while at < len(raw):
            space = b[at + _BLOCK :]
            end = at + _BLOCK + int(space.argmax()) if len(space) and space[int(space.argmax())] else len(raw)
            parts.append(_block_hashes(raw[at:end]))
            at = end
        return np.concatenate(parts)
    return _block_hashes(raw)


def _block_hashes(raw: bytes) -> np.ndarray:
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(b) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
        return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _M3)


def shingle_set(text: str | None, words: int = 2) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-word shingles of a whole text.

    A text with fewer words than that is one shingle, its whole sequence; no words, no shingle.
    """
    if not text:
        return np.empty(0, np.uint64)
    h = word_hashes(text.encode("utf-8", "surrogatepass"))
    if not len(h):
        return h
    k = min(words, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            out = mix64(out * _M1 + h[i : len(h) - k + 1 + i])
        if k < words:
            out = mix64(out + np.uint64(k))
    return np.unique(out)
