"""Exact top-k search by inner product with a three-phase uniform threshold.

A vector's dimensions are parted into ``GROUPS`` lists; a score is the sum of its groups' partial
scores. All lists of a vector lie in one task, so only bounds travel:

1. every task takes from each of its local lists the k best entries for each query, adds up what is
   known of them (for a missing part, the list's least value) and passes on their bounds; the k-th
   best of all tasks' bounds is a lower bound of the query's k-th score;
2. that cutoff is broadcast. In each list the entries of at least its share (cutoff over the number of
   lists) are enough: a vector below it in all lists is below the cutoff;
3. of these, the vectors whose upper bound reaches the cutoff get their remaining parts and their exact
   score; each task passes on its k best, and the k best of those are the answer.

Queries go through in blocks of at most ``QUERY_BLOCK`` rows and ``QUERY_NUMBERS`` components, which bounds
what is broadcast. A block's results are written and its broadcasts go before the next one comes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import stage
from codeloom.sources.staging import new_path

GROUPS = 4
#: Queries of one pass, and their components: a matrix of 16 MB at most.
QUERY_BLOCK, QUERY_NUMBERS = 32_768, 1 << 21
#: Queries and vectors whose partial scores are held at once.
TILE_Q, TILE_V = 512, 4_096


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and ``q``, floor(scale * x) of each component as double; rows that can't take part go.

    Null vectors, vectors with a null or non-finite component and null ids can't, nor can empty
    ones. Components are exact whole numbers as long as they are below 2**53.
    """
    parts = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(parts, lambda x: F.floor(x * scale).cast("double")).alias("q"))
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _tiles(batches, width: int):
    """Row numbers, ids and matrix of up to TILE_V vectors at a time."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, TILE_V):
            part = batch.slice(at, TILE_V)
            held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), width)))
            n += part.num_rows
            if n >= TILE_V:
                yield tuple(map(np.concatenate, zip(*held)))
                held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held)))


def _cuts(width: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, width, min(GROUPS, width) + 1).astype(int).tolist()
    return list(zip(edges, edges[1:]))


def _partials(queries: np.ndarray, vectors: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """(lists, queries, vectors) partial scores."""
    return np.stack([queries[:, a:b] @ vectors[:, a:b].T for a, b in cuts])


def _search_block(candidates: DataFrame, query_rows: np.ndarray, queries: np.ndarray, k: int, path: str) -> None:
    """Append the answers of a block of queries (by the numbers of their rows) to the table at ``path``."""
    sc, width = candidates.sparkSession.sparkContext, queries.shape[1]
    shared = sc.broadcast((query_rows, queries))
    cuts = _cuts(width)

    def bounds(batches):
        qid, q = shared.value
        best = np.full((len(qid), k), -np.inf)
        least = np.full((len(cuts), len(qid)), np.inf)
        for row, _, v in _tiles(batches, width):
            for at in range(0, len(qid), TILE_Q):
                p = _partials(q[at : at + TILE_Q], v, cuts)
                low = p.min(2)
                least[:, at : at + TILE_Q] = np.minimum(least[:, at : at + TILE_Q], low)
                p[:, qid[at : at + TILE_Q, None] == row[None, :]] = -np.inf  # a query is no candidate of its own
                n = min(k, len(row))
                top = np.argpartition(-p, n - 1, axis=2)[:, :, :n]
                # an entry is known in the lists whose best it is among, and elsewhere at least the least
                r = np.arange(p.shape[1])[:, None]
                seen = np.zeros(p.shape, bool)
                for g in range(len(cuts)):
                    seen[g, r, top[g]] = True
                some = np.concatenate(list(top), 1)
                known = sum(np.where(seen[g, r, some], p[g, r, some], low[g][:, None]) for g in range(len(cuts)))
                order = np.argsort(some, 1, kind="stable")
                some, known = np.take_along_axis(some, order, 1), np.take_along_axis(known, order, 1)
                known[:, 1:][some[:, 1:] == some[:, :-1]] = -np.inf  # one entry of several lists counts once
                both = np.concatenate([best[at : at + TILE_Q], known], 1)
                best[at : at + TILE_Q] = -np.partition(-both, k - 1, axis=1)[:, :k]
        rows, col = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(qid[rows]), pa.array(best[rows, col])], names=["query", "bound"])

    local = candidates.mapInArrow(bounds, "query long, bound double")
    ranked = local.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound")))).where(F.col("r") == k)
    cutoffs = dict(ranked.select("query", "bound").toPandas().itertuples(index=False, name=None))  # at most a row per query of the block
    cutoff = sc.broadcast(np.array([cutoffs.get(i, -np.inf) for i in query_rows.tolist()]))

    def resolve(batches):
        qid, q = shared.value
        t = cutoff.value
        best_s, best_v = np.full((len(qid), k), -np.inf), np.full((len(qid), k), np.iinfo(np.int64).max)
        for row, vid, v in _tiles(batches, width):
            for at in range(0, len(qid), TILE_Q):
                p = _partials(q[at : at + TILE_Q], v, cuts)
                mine = t[at : at + TILE_Q]
                # enough are the entries of at least their share of the cutoff; the rest of their parts is added to these
                enough = p.max(0) >= (mine / len(cuts))[:, None]
                score = p.sum(0)
                enough &= score >= mine[:, None]
                enough &= qid[at : at + TILE_Q, None] != row[None, :]
                rows, cols = np.nonzero(enough)
                if not len(rows):
                    continue
                score = score[rows, cols]
                order = np.lexsort((vid[cols], -score, rows))
                rows, ids, score = rows[order], vid[cols[order]], score[order]
                first = np.searchsorted(rows, rows)
                place = np.arange(len(rows)) - first
                top = place < k
                new_s, new_v = np.full((len(mine), k), -np.inf), np.full((len(mine), k), np.iinfo(np.int64).max)
                new_s[rows[top], place[top]], new_v[rows[top], place[top]] = score[top], ids[top]
                touched = np.unique(rows)
                s = np.concatenate([best_s[at + touched], new_s[touched]], 1)
                w = np.concatenate([best_v[at + touched], new_v[touched]], 1)
                order = np.lexsort((w, -s), axis=1)[:, :k]
                best_s[at + touched], best_v[at + touched] = np.take_along_axis(s, order, 1), np.take_along_axis(w, order, 1)
        rows, col = np.nonzero(np.isfinite(best_s))
        yield pa.RecordBatch.from_arrays(
            [pa.array(qid[rows]), pa.array(best_v[rows, col]), pa.array(best_s[rows, col].astype(np.int64))], names=["query", "vec_id", "score"]
        )

    found = candidates.mapInArrow(resolve, "query long, vec_id long, score long")
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    found.withColumn("rank", order.cast("int")).where(F.col("rank") <= k).select("query", "rank", "vec_id", "score").write.mode("append").parquet(path)
    shared.destroy()
    cutoff.destroy()


def search(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The ``k`` highest scores of each vector whose id is divisible by ``every``: query_id, rank,
    vec_id, score. Ties go to the smaller vec_id; all rows but the query's own are candidates.

    Rows that ``quantized`` leaves out take no part; vectors meet those of their own length. Rows that
    share an id are each a candidate, for one another too, and each a query if the id is one: each has its ``k`` answers. Fewer
    than k candidates give fewer rows; an empty table gives none. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    usable = stage(quantized(vectors).select(F.monotonically_increasing_id().alias("row"), "vec_id", "q"), "topk")
    path = new_path(spark, "topk-found")
    queries = usable.where(F.col("vec_id") % every == 0)
    widths = [r.n for r in queries.select(F.size("q").alias("n")).distinct().orderBy("n").collect()]
    for width in widths:
        candidates = usable.where(F.size("q") == width)
        wanted, after, size = queries.where(F.size("q") == width), None, max(1, min(QUERY_BLOCK, QUERY_NUMBERS // width))
        while True:
            block = (wanted if after is None else wanted.where(F.col("row") > after)).orderBy("row").limit(size).toPandas()
            if len(block):
                _search_block(candidates, block.row.to_numpy(np.int64), np.array(block.q.tolist(), float), k, path)
                after = int(block.row.iloc[-1])
            if len(block) < size:
                break
    found = spark.read.schema("query long, rank int, vec_id long, score long").parquet(path) if widths else spark.range(0).selectExpr("id query", "cast(id as int) rank", "id vec_id", "id score")
    return found.join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(embedding) > 0
    AND len([x for x in embedding if NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([a.q[i] * b.q[i] for i in range(1, len(a.q) + 1)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
