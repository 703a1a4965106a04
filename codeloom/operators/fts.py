"""Full-text search: index documents, postings, weighted BM25, substring and reference search, snippets."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import expand_query, fts_text, fts_tokens, identifier_tokens, morphology, morphology_table, reference_terms
from codeloom.operators import trigrams
from codeloom.schema import kind_order
from codeloom.sources.files import matches_glob
from codeloom.sources.layers import Layered
from codeloom.sources.staging import stage

WEIGHTS = {"name": 10, "signature": 5, "docstring": 4, "decorators": 5, "path": 2, "body": 1, "neighbors": 1, "morph": 1}
K1, B = 1.2, 0.75
SCALE = 1e6


def _words(c: Column) -> Column:
    return F.concat_ws(" ", F.filter(c, lambda x: x != ""))


def index_documents(nodes: DataFrame) -> DataFrame:
    """A row per node: node_id, kind, seven text fields as they are indexed, and the raw text of all."""
    m = F.col("meta")
    none = F.array().cast("array<string>")
    raw = {
        "name": F.coalesce("name", F.lit("")),
        "signature": F.coalesce(m.signature, F.lit("")),
        "docstring": F.coalesce(m.docstring, F.lit("")),
        "decorators": _words(F.coalesce(m.decorators, none)),
        "path": F.coalesce("path", F.lit("")),
        "body": _words(F.concat(F.array(F.coalesce(m.body_preview, F.lit(""))), F.coalesce(m.terms, none))),
        "neighbors": _words(F.concat(F.coalesce(m.neighbors, none), F.coalesce(m.exports, none), F.coalesce(m.routes, none), F.coalesce(m.imports, none), F.array_compact(F.array(m.parent)))),
    }
    return nodes.select(F.col("id").alias("node_id"), "kind", *[fts_text(c).alias(f"f_{k}") for k, c in raw.items()], F.concat_ws(" ", *raw.values()).alias("raw"))


def postings(documents: DataFrame, fields: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """(node_id, kind, field, term, tf). The ``morph`` field holds each document's distinct word forms: they
    are made once per distinct word of the corpus and joined to the documents' distinct words."""
    plain = [f for f in fields if f != "morph"]
    by_field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), fts_tokens(F.col(f"f_{f}")).alias("tokens")) for f in plain])).alias("x")
    tokens = documents.select("node_id", "kind", by_field).select("node_id", "kind", "x.field", F.explode("x.tokens").alias("term"))
    out = tokens.groupBy("node_id", "kind", "field", "term").agg(F.count("*").cast("int").alias("tf"))
    if "morph" in fields:
        words = documents.select("node_id", "kind", F.explode(F.array_distinct(identifier_tokens(F.col("raw")))).alias("token"))
        forms = words.join(morphology_table(words), "token").select("node_id", "kind", F.lit("morph").alias("field"), F.col("variant").alias("term")).distinct()
        out = out.unionByName(forms.withColumn("tf", F.lit(1)))
    return out


def one_row_each(documents: DataFrame) -> DataFrame:
    """``documents`` with the texts of rows that share a node joined; only then are they shuffled."""
    if documents.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return documents
    texts = [c for c in documents.columns if c not in ("node_id", "kind")]
    return documents.groupBy("node_id").agg(F.min("kind").alias("kind"), *[F.array_join(F.collect_list(c), " ").alias(c) for c in texts])


def word_forms(documents: DataFrame) -> DataFrame:
    """``documents`` with ``f_morph``, the distinct forms of their words: those of ``postings``, row by row, without a shuffle."""

    @F.pandas_udf("array<string>")
    def forms(words: pd.Series) -> pd.Series:
        known = {w: morphology(w) for some in words for w in some}
        return words.map(lambda some: list(dict.fromkeys(form for w in some for form in known[w])))

    return documents.withColumn("f_morph", forms(F.array_distinct(identifier_tokens(F.col("raw")))))


def doc_stats(index: DataFrame) -> DataFrame:
    """(node_id, n_tokens) over all fields."""
    return index.groupBy("node_id").agg(F.sum("tf").cast("long").alias("n_tokens"))


def doc_lengths(documents: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``doc_stats`` of the plain ``fields`` straight from the documents: no posting is made, nothing shuffled."""
    sizes = [F.size(fts_tokens(F.col(f"f_{f}"))) for f in fields]
    return documents.select("node_id", reduce(Column.__add__, sizes).cast("long").alias("n_tokens")).where("n_tokens > 0")


#: Folders that stored postings are spread over by their term.
BUCKETS = 64


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def bucketed(index: DataFrame) -> DataFrame:
    """``index`` with the folder (bucket) of each posting, one file or few per folder."""
    return index.withColumn("bucket", bucket_of(F.col("term"))).repartition(F.col("bucket"), F.pmod(F.xxhash64("node_id"), F.lit(4)))


def of_terms(index: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of ``terms``; of an index stored by bucket only their folders are read."""
    hits = index.where(F.col("term").isin(terms))
    if "bucket" not in index.columns:
        return hits
    spark = index.sparkSession
    folders = sorted({r.b for r in spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in terms])).alias("t")).select(bucket_of(F.col("t")).alias("b")).collect()}) if terms else []
    return hits.where(F.col("bucket").isin(folders))


def bm25(index: DataFrame, stats: DataFrame, terms: list[str], weights: dict[str, float] | None = None, kinds: str | None = None, n_docs: int | None = None) -> DataFrame:
    """(node_id, bm25) of documents with any of ``terms``: only the terms' postings are read.

    ``n_docs`` counts documents without tokens too; else those of ``stats`` count.
    """
    weights = weights or WEIGHTS
    weight = F.coalesce(*[F.when(F.col("field") == f, float(w)) for f, w in weights.items()], F.lit(1.0))
    hits = of_terms(index, terms).groupBy("node_id", "kind", "term").agg(F.sum(weight * F.col("tf")).alias("tf"))
    total = F.lit(float(n_docs)) if n_docs is not None else stats.agg(F.count("*").cast("double")).scalar()
    average = stats.agg(F.sum("n_tokens").cast("double")).scalar() / total
    found = hits.groupBy("term").agg(F.count("*").alias("df"))  # a query's few terms
    idf = F.log((total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    part = F.col("idf") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / average)) * (K1 + 1)
    rows = hits.where(F.col("kind") == kinds) if kinds else hits
    return rows.join(F.broadcast(found.select("term", idf.alias("idf"))), "term").join(stats, "node_id").groupBy("node_id").agg(F.sum(part).alias("bm25"))


def bm25_once(documents: DataFrame, terms: list[str], weights: dict[str, float] | None = None, fields: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """(node_id, bm25) of all ``documents`` with any of ``terms`` over ``fields``, from one reading and without postings: a
    document's frequencies of the terms and its length, word forms among them, are worked out where its row is. The forms
    outnumber the tokens by far, so for a single query they are neither shuffled nor stored."""
    terms, weights = sorted(set(terms)), weights or WEIGHTS
    plain = [f for f in fields if f != "morph"]

    @F.pandas_udf("struct<n long, found array<string>>")
    def forms(words: pd.Series) -> pd.DataFrame:
        known = {w: morphology(w) for some in words for w in some}
        sets = [set().union(*[known[w] for w in some]) for some in words]
        return pd.DataFrame({"n": [len(x) for x in sets], "found": [[t for t in terms if t in x] for x in sets]})

    raw = identifier_tokens(F.col("raw")) if "morph" in fields else F.array().cast("array<string>")
    tokens = one_row_each(documents).select("node_id", "raw", *[fts_tokens(F.col(f"f_{f}")).alias(f) for f in plain])
    # the terms among the tokens are few: they are told apart after the filter
    sizes = reduce(Column.__add__, [F.size(f) for f in plain])
    kept = tokens.select("node_id", F.array_distinct(raw).alias("words"), sizes.cast("long").alias("n"), *[F.filter(f, lambda x: x.isin(terms)).alias(f) for f in plain])
    none = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("found"))
    said = stage(kept.select("node_id", "n", *plain, (forms("words") if "morph" in fields else none).alias("m")), "frequencies")
    count = lambda f, t: F.size(F.filter(F.col(f), lambda x: x == t)) * float(weights.get(f, 1.0))
    heavy = [reduce(Column.__add__, [count(f, t) for f in plain]) + F.array_contains("m.found", t).cast("int") * float(weights.get("morph", 1.0)) for t in terms]
    held = [reduce(lambda a, b: a | b, [F.array_contains(f, t) for f in (*plain, "m.found")]) for t in terms]
    rows = said.select("node_id", (F.col("n") + F.col("m.n")).alias("n_tokens"), F.array(*heavy).alias("tf"), F.array(*held).alias("held")).where("n_tokens > 0")
    known = rows.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), *[F.count_if(F.get("held", F.lit(i))).alias(f"d{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log((known.n - known[f"d{i}"] + 0.5) / (known[f"d{i}"] + 0.5))
        tf = F.get("tf", F.lit(i))
        part = (idf if idf > 0 else 1e-6) * tf / (tf + K1 * (1 - B + B * F.col("n_tokens") / (known.t / known.n if known.n else 1))) * (K1 + 1)
        score = score + F.when(F.get("held", F.lit(i)), part).otherwise(0.0)
    return rows.where(F.exists("held", lambda x: x)).select("node_id", score.alias("bm25"))


def search_bm25(nodes: DataFrame, index: DataFrame, stats: DataFrame, query: str, candidates: int = 32, kind: str | None = None, glob: str | None = None) -> DataFrame:
    """Nodes with ``score`` and ``rank``: the best ``candidates`` by the full score of all documents with any term."""
    return ranked(nodes, bm25(index, stats, expand_query(query), kinds=kind), candidates, glob)


def ranked(nodes: DataFrame, scored: DataFrame, candidates: int = 32, glob: str | None = None) -> DataFrame:
    """Nodes of ``scored`` (node_id, bm25) with ``score`` and ``rank``: the best ``candidates`` by score, kind, path and
    name; the glob filters after the cut, so ranks keep their places."""
    hits = scored.withColumn("score", F.round(F.col("bm25") * SCALE, 4))
    order = [F.desc("bm25"), kind_order(), F.asc_nulls_first("path"), "name", "id"]
    top = nodes.join(hits, nodes.id == hits.node_id).drop("node_id").orderBy(*order).limit(candidates)
    out = top.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order))).drop("bm25")
    return out.where(matches_glob(F.col("path"), glob)) if glob else out


def over_fetch(limit: int, glob: str | None = None) -> int:
    return max(limit * 20, 500) if glob else max(limit * 4, 25)


def contains(c: Column, query: str) -> Column:
    """Substring match that folds the case of ASCII letters alone; ``%`` and ``_`` are wildcards."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = f"%{query}%".translate(str.maketrans(upper, lower)).replace("\\", "\\\\")
    return F.translate(c, upper, lower).like(pattern)


def name_hits(nodes: DataFrame, query: str, grams: Layered | None = None) -> DataFrame:
    """Nodes whose name, path or id contains ``query``; with a trigram index only its candidates are matched."""
    hit = contains(F.col("name"), query) | F.coalesce(contains(F.col("path"), query), F.lit(False)) | contains(F.col("id"), query)
    return trigrams.narrowed(nodes, grams, query).where(hit)


def reference_hits(index: DataFrame, query: str) -> DataFrame:
    """node_id of documents in which all the query's words occur, in any field."""
    terms = reference_terms(query)
    found = of_terms(index, terms).groupBy("node_id").agg(F.count_distinct("term").alias("n"))
    return found.where(F.col("n") == len(set(terms))).where(F.lit(bool(terms))).select("node_id")


def search(nodes: DataFrame, index: DataFrame, query: str, limit: int = 20, grams: Layered | None = None) -> DataFrame:
    """Nodes with ``match``: those whose name, path or id contains the query, then those that refer to it."""
    by_name = name_hits(nodes, query, grams).withColumn("match", F.lit("name"))
    refers = nodes.join(reference_hits(index, query), F.col("id") == F.col("node_id"), "left_semi").join(by_name.select("id"), "id", "left_anti")
    both = by_name.unionByName(refers.withColumn("match", F.lit("reference")))
    branch = F.when(F.col("match") == "name", 0).otherwise(1)
    path = F.when(F.col("match") == "reference", F.coalesce("path", F.lit("")))
    return both.orderBy(branch, kind_order(), F.asc_nulls_first(path), "name", "id").limit(limit)


def snippet(meta: str = "meta") -> Column:
    """The first of docstring, signature and body that isn't blank."""
    m = F.col(meta)
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in (m.docstring, m.signature, m.body_preview)])
