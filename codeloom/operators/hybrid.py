"""Rank fusion of lexical and vector results, grouping by file, and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import name_terms
from codeloom.schema import kind_rank
from codeloom.sources.files import is_test_result

RRF_K = 60
#: Words of a name that mark the entry to a topic.
ENTRY_VERBS = tuple("handle initiate create process route dispatch terminate run execute start stop register listen accept serve consume publish send".split())
CONVERSIONS = ("convert", "conversion")


def rrf(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """(id, score, score_sources, score_source) from rows (id, source, rank): sums of 1 / (k + rank) as shares
    of the largest, to four places."""
    sums = ranked.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("raw"), F.sort_array(F.collect_set("source")).alias("score_sources"))
    best = sums.agg(F.max("raw")).scalar()
    return sums.select(
        "id", F.round(F.col("raw") / best, 4).alias("score"), "score_sources", F.when(F.size("score_sources") > 1, "hybrid").otherwise(F.col("score_sources")[0]).alias("score_source")
    )


def fuse(nodes: DataFrame, lexical: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """Nodes of either ranked list with the fused score and ``place`` in its order."""
    rows = lexical.select("id", F.lit("bm25").alias("source"), "rank").unionByName(vectors.select("id", F.lit("local-hash").alias("source"), "rank"))
    order = [F.desc("score"), kind_rank(), F.coalesce("path", F.lit("")), "name", "id"]
    return nodes.join(rrf(rows), "id").withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*order))).where(F.col("place") <= limit)


def group_by_file(results: DataFrame, limit: int, shown: int = 5, collapse_all: bool = False) -> DataFrame:
    """Symbols of one path behind the first of them. ``results`` has id, kind, name, path, line, score, place.

    A path's first ``shown`` symbols are one group, led by the first, with the others of them as
    ``co_located_symbols``. Later symbols of a longer path are each a row of their own that lists the first
    ones; ``collapse_all`` leaves them out. Rows have ``co_located_total`` and ``co_located_truncated``.
    """
    is_symbol = (F.col("kind") == "symbol") & (F.coalesce("path", F.lit("")) != "")
    key = F.when(is_symbol, F.concat(F.lit("p:"), "path")).otherwise(F.concat(F.lit("i:"), "id"))
    numbered = results.withColumn("key", key).withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("place")))
    # of a path's symbols only the first ones are gathered
    item = F.when(F.col("nth") <= shown, F.struct("nth", F.struct("name", "line", "id", "score").alias("item")))
    paths = numbered.groupBy("key").agg(F.count("*").alias("siblings"), F.transform(F.sort_array(F.collect_list(item)), lambda x: x.item).alias("first"))
    leads = (F.col("nth") == 1) | (F.col("nth") > shown) & F.lit(not collapse_all)
    many = F.col("siblings") > 1
    return (
        numbered.where(leads)
        .join(paths, "key")
        .withColumn("co_located_symbols", F.when(many, F.filter("first", lambda x: x.id != F.col("id"))))
        .withColumn("co_located_total", F.when(many, F.col("siblings") - 1))
        .withColumn("co_located_truncated", F.when(many & (F.col("siblings") > shown), F.lit(True)))
        .drop("key", "nth", "siblings", "first")
        .orderBy("place")
        .limit(limit)
    )


def anchor_order(topic: str) -> list[Column]:
    """Sort keys of a topic's anchor: no test, most words in common, no conversion, an entry verb, the score."""
    terms = name_terms(F.concat_ws(" ", "name", "path", "id"))
    asked = name_terms(F.lit(topic))
    has = lambda words: F.arrays_overlap(terms, F.array(*[F.lit(w) for w in words])).cast("int")
    test = ((F.col("kind") == "test") | is_test_result(F.col("path"))).cast("int")
    return [test, F.desc(F.size(F.array_intersect(terms, asked))), has(CONVERSIONS), F.desc(has(ENTRY_VERBS)), F.desc(F.coalesce("score", F.lit(0.0))), F.coalesce("path", F.lit("")), F.coalesce("line", F.lit(0)), "name"]


def anchor(results: DataFrame, topic: str) -> DataFrame:
    """The one row that explains ``topic`` best: among symbols, else files, else the first of all."""
    tier = F.when(F.col("kind") == "symbol", 0).when(F.col("kind").isin("file", "test"), 1).otherwise(2)
    return results.orderBy(tier, *anchor_order(topic), "id").limit(1)
