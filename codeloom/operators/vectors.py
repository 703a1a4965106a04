"""Hashed embeddings, nearest neighbours and providers."""

from __future__ import annotations

import hashlib
import os
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.text import vector_tokens
from codeloom.schema import kind_rank
from codeloom.sources.files import matches_glob

DIMENSIONS = 256
MODEL = "hash-256-v1"


def semantic_text(nodes: DataFrame) -> DataFrame:
    """(node_id, text, content_sha1): what of a node is embedded."""
    m = F.col("meta")
    scalars = [m[k] for k in ("symbol_kind", "route", "method", "import", "signature", "docstring", "body_preview", "handler", "parent")]
    lists = [F.coalesce(m[k], F.array().cast("array<string>")) for k in ("decorators", "exports", "routes", "neighbors", "terms")]
    parts = F.concat(
        F.array(F.coalesce("kind", F.lit("")), F.coalesce("name", F.lit("")), F.coalesce("path", F.lit(""))), F.filter(F.array(*scalars), lambda x: x.isNotNull() & (x != "")), *lists
    )
    return nodes.select(F.col("id").alias("node_id"), F.array_join(parts, " ").alias("text")).withColumn("content_sha1", F.sha1(F.encode("text", "UTF-8")))


class HashedWords:
    """A worker's memory of words: the buckets and signs of their features, in one array that grows by doubling."""

    REMEMBERED = 200_000
    #: Pieces of words whose hashes are kept; words share most of theirs.
    PIECES = 400_000

    def __init__(self, model: str, dimensions: int):
        self.key, self.dimensions = model.encode()[:16] or b"codeloom", dimensions
        self.pieces: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.codes = np.zeros(1024, np.int64), np.empty(8192, np.int64)

    def features(self, word: str) -> list[str]:
        """The word itself, and the three- and four-letter pieces of it between ``^`` and ``$``."""
        padded = f"^{word}$"
        return [f"t:{word}", *(f"{n}:{padded[i : i + n]}" for n in (3, 4) for i in range(len(padded) - n + 1))]

    def code(self, feature: str) -> int:
        """Twice the feature's bucket, and one more if its sign is positive."""
        digest = hashlib.blake2b(feature.encode(), digest_size=8, key=self.key).digest()
        return int.from_bytes(digest[:4], "little") % self.dimensions * 2 + (digest[4] & 1)

    def places(self, words: list[str]) -> np.ndarray:
        if len(self.place) + len(words) > self.REMEMBERED:
            self.forget()
        new, pieces = [w for w in dict.fromkeys(words) if w not in self.place], self.pieces
        if new:
            if len(pieces) > self.PIECES:
                pieces.clear()
            codes, sizes = [], []
            for w in new:
                whole, *rest = self.features(w)
                codes.append(self.code(whole))
                for f in rest:
                    c = pieces.get(f)
                    if c is None:
                        c = pieces[f] = self.code(f)
                    codes.append(c)
                sizes.append(1 + len(rest))
            n = len(self.place)
            self.starts = _grown(self.starts, n + 1 + len(new))
            at = int(self.starts[n])
            self.codes = _grown(self.codes, at + len(codes))
            self.codes[at : at + len(codes)] = codes
            self.starts[n + 1 : n + 1 + len(new)] = at + np.cumsum(sizes)
            self.place.update(zip(new, range(n, n + len(new))))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def vectors(self, words: pa.ListArray) -> np.ndarray:
        """A unit vector of each list of words: signed counts of hashed features; zeros for an empty list."""
        n, sizes = len(words), np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        places = self.places(coded.dictionary.to_pylist())
        document = np.repeat(np.arange(n), sizes)
        pair, count = np.unique(document * max(1, len(places)) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        document, word = np.divmod(pair, max(1, len(places)))
        begin, size = self.starts[places[word]], self.starts[places[word] + 1] - self.starts[places[word]]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        code = self.codes[at]
        cell = np.repeat(document * self.dimensions, size) + (code >> 1)
        sums = np.bincount(cell, np.repeat(count, size) * ((code & 1) * 2 - 1), n * self.dimensions).astype(float).reshape(n, self.dimensions)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        return np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with room for ``n`` entries at the least."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


_HELD: dict[tuple[str, int], HashedWords] = {}


def _held_words(model: str, dimensions: int) -> HashedWords:
    """The worker's memory: tasks that it runs later find what earlier ones have hashed. One is held at a time."""
    if (model, dimensions) not in _HELD:
        _HELD.clear()
        _HELD[model, dimensions] = HashedWords(model, dimensions)
    return _HELD[model, dimensions]


#: Words of documents whose features are spread out at a time.
PORTION = 100_000


def embed(documents: DataFrame, model: str = MODEL, dimensions: int = DIMENSIONS) -> DataFrame:
    """(node_id, vector): signed counts of hashed features, of unit length; zeros for a text without tokens.

    The keyed hash is no built-in function. Words are split in the JVM and go through Python in Arrow
    batches, once, without a shuffle; each worker hashes a word once.
    """
    dimensions = dimensions if dimensions > 0 else DIMENSIONS

    def run(batches):
        words = _held_words(model, dimensions)
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            ends = np.searchsorted(np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)), np.arange(PORTION, len(lists.flatten()) + PORTION, PORTION))
            edges = np.unique([0, *np.minimum(ends + 1, len(lists)), len(lists)]).tolist()
            for a, b in zip(edges, edges[1:]):
                flat = words.vectors(pa.concat_arrays([lists.slice(a, b - a)])).astype(np.float32).ravel()
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dimensions), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), vectors], names=["node_id", "vector"])

    return documents.select("node_id", F.coalesce(vector_tokens(F.col("text")), F.array().cast("array<string>")).alias("words")).mapInArrow(
        run, f"node_id {documents.schema['node_id'].dataType.simpleString()}, vector array<float>"
    )


def embed_query(spark: SparkSession, text: str, model: str = MODEL, dimensions: int = DIMENSIONS) -> list[float]:
    words = spark.range(1).select(vector_tokens(F.lit(text)).alias("words")).first().words
    return HashedWords(model, dimensions).vectors(pa.array([words], pa.list_(pa.string())))[0].astype(np.float32).tolist()


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for unequal lengths or a zero vector."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), _dot(a, b) / norms).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda acc, x: acc + x))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def knn(embeddings: DataFrame, query: list[float] | Column, k: int, metric: str = "l2", key: str = "node_id", vector: str = "vector") -> DataFrame:
    """The ``k`` nearest rows: distance and 1 / (1 + distance) by l2, or the cosine where it is positive."""
    q = query if isinstance(query, Column) else literal(query)
    if metric == "cosine":
        scored = embeddings.withColumn("score", cosine(F.col(vector), q)).where("score > 0")
        return scored.orderBy(F.desc("score"), key).limit(k)
    scored = embeddings.where(F.size(vector) == F.size(q)).withColumn("distance", euclidean(F.col(vector), q))
    return scored.withColumn("score", 1 / (1 + F.col("distance"))).orderBy("distance", key).limit(k)


def search(nodes: DataFrame, embeddings: DataFrame, query: list[float], candidates: int, metric: str = "l2", kind: str | None = None, glob: str | None = None, prefilter: bool = False, near: DataFrame | None = None) -> DataFrame:
    """Nodes with score and rank by distance. Kind and glob filter what the neighbours are, after the cut,
    unless ``prefilter`` asks for them before it. ``near`` are the neighbours, if an index has found them."""
    wanted = nodes
    if kind:
        wanted = wanted.where(F.col("kind") == kind)
    if glob:
        wanted = wanted.where(matches_glob(F.col("path"), glob))
    pool = embeddings.join(wanted.select(F.col("id").alias("node_id")), "node_id", "left_semi") if prefilter else embeddings
    near = knn(pool, query, candidates, metric) if near is None else near
    order = [F.desc("raw"), kind_rank(), F.coalesce("path", F.lit("")), "name", "id"]
    found = wanted.join(near.select(F.col("node_id").alias("id"), F.col("score").alias("raw"), *(["distance"] if metric == "l2" else [])), "id")
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order))).withColumn("score", F.round("raw", 4)).drop("raw")
    return out.withColumn("distance", F.round("distance", 6)) if metric == "l2" else out


class Provider(Protocol):
    """What embeds texts: a name, a model, and vectors for a list of texts."""

    name: str
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


#: Environment variables that choose a hosted provider, in order, and models by provider.
PROVIDER_ENV = ((("VOYAGE_API_KEY",), "voyage"), (("OPENAI_API_KEY",), "openai"), (("CODELOOM_EMBED_API_KEY", "CODELOOM_EMBED_BASE_URL"), "openai-compatible"))
MODELS = {"local": MODEL, "ollama": "embeddinggemma", "voyage": "voyage-code-3", "openai": "text-embedding-3-small", "openai-compatible": "text-embedding-3-small"}


def detect_provider(env: dict[str, str] | None = None) -> str:
    """The provider that the environment asks for; the local hash without any."""
    env = os.environ if env is None else env
    return next((name for keys, name in PROVIDER_ENV if all(env.get(k) for k in keys)), "local")


def provider_choice(provider: str | None = None, model: str | None = None, dimensions: int | None = None, env: dict[str, str] | None = None) -> tuple[str, str, int | None]:
    """(provider, model, dimensions): arguments come before the environment, and that before defaults."""
    env = os.environ if env is None else env
    name = provider or env.get("CODELOOM_EMBED_PROVIDER") or detect_provider(env)
    if name not in MODELS:
        raise ValueError(f"no embedding provider of this name: {name}")
    size = dimensions or int(env.get("CODELOOM_EMBED_DIMENSIONS") or 0) or (DIMENSIONS if name == "local" else None)
    return name, model or env.get("CODELOOM_EMBED_MODEL") or MODELS[name], size


def embed_remote(documents: DataFrame, provider: Provider, batch: int = 64) -> DataFrame:
    """(node_id, vector) from a provider, ``batch`` texts a request, on the executors."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                some = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"node_id": some.node_id, "vector": provider.embed(list(some.text))})

    return documents.select("node_id", "text").mapInPandas(run, "node_id string, vector array<float>")


def sparse_cosine(bags: DataFrame, left: str, right: str) -> DataFrame:
    """Cosine of term counts between the documents ``left`` and ``right`` of ``bags`` (id, term, n)."""
    norms = bags.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    a = bags.where(F.col("id") == left).select("term", F.col("n").alias("na"))
    b = bags.where(F.col("id") == right).select("term", F.col("n").alias("nb"))
    dot = a.join(b, "term").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("dot"))
    lengths = norms.where(F.col("id").isin(left, right)).agg(F.product("norm").alias("norms"))
    return dot.select((F.col("dot") / lengths.select("norms").scalar()).alias("cosine"))
