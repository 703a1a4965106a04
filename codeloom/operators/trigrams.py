"""A trigram index of nodes: substring searches read the rows of the pattern's trigrams, then match what they name.

A row is a trigram and a node, with a bit for each of name, path and id that it occurs in; ASCII letters are folded as the
search folds them. A node may match only if one field has all trigrams of the pattern's literal parts.
Patterns without three literal characters in a row have none, and are matched against all nodes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.layers import Layered, buckets_of, hash_bucket

FIELDS = ("name", "path", "id")
BUCKETS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str) -> Layered:
    """The stored index: (gram, id, fields)."""
    return Layered(spark, folder, ["id"], hash_bucket("gram", BUCKETS))


def _grams(c: Column) -> Column:
    folded = F.translate(c, UPPER, LOWER)
    places = F.when(F.length(folded) >= 3, F.sequence(F.lit(1), F.length(folded) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(folded, i, 3)))


def rows(nodes: DataFrame) -> DataFrame:
    """(gram, id, fields) of ``nodes``: one row for each trigram of a node; nothing is shuffled."""
    by_field = [_grams(F.coalesce(c, F.lit(""))) for c in FIELDS]
    every = F.array_distinct(F.concat(*by_field))
    bits = lambda g: sum((F.when(F.array_contains(a, g), 1 << i).otherwise(0) for i, a in enumerate(("_0", "_1", "_2"))), F.lit(0))
    held = nodes.select("id", *[a.alias(f"_{i}") for i, a in enumerate(by_field)], every.alias("_all"))
    return held.select("id", "_0", "_1", "_2", F.explode("_all").alias("gram")).select("gram", "id", bits(F.col("gram")).alias("fields"))


def pattern_grams(query: str) -> list[str]:
    """Trigrams that whatever ``query`` matches must have: ``%`` and ``_`` are wildcards."""
    folded = query.translate(str.maketrans(UPPER, LOWER))
    return sorted({part[i : i + 3] for part in re.split("[%_]", folded) for i in range(len(part) - 2)})


def candidates(index: Layered, query: str, fields: tuple[str, ...] = FIELDS) -> DataFrame | None:
    """id of nodes of which one of ``fields`` has all of the pattern's trigrams; None if it has none to go by."""
    grams = pattern_grams(query)
    if not grams:
        return None
    asked = sum(1 << FIELDS.index(f) for f in fields)
    found = index.read(buckets_of(index.spark, grams, BUCKETS)).where(F.col("gram").isin(grams))
    return found.groupBy("id").agg(F.count("*").alias("n"), F.bit_and("fields").alias("in")).where((F.col("n") == len(grams)) & (F.col("in").bitwiseAND(asked) > 0)).select("id")


def narrowed(nodes: DataFrame, index: Layered | None, query: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``nodes`` that may match ``query``; all of them without an index, or if the pattern has no trigram."""
    some = candidates(index, query, fields) if index is not None else None
    return nodes if some is None else nodes.join(some, "id", "left_semi")
