"""A text index that changes in place and answers ranked queries without reading all postings of their terms.

Documents are dealt to spans: documents of similar length, about ``SPAN`` of them, by length class and hash. The postings of
a term in a span are one stored block: the greatest weighted frequency and that in each field, the least document length,
and the documents. A block's bound is the score of a document with that frequency and that length, so the sum of a span's bounds
over a query's terms is a bound for each of its documents. A query first scores a few spans of highest bound,
whose k-th score is a floor for the answer, and then only the spans whose bound reaches it.

Beside the postings are kept: each document's length and terms, the number of documents of each term, and totals.
A change of some documents takes their old terms from the kept ones, so it reads and writes what concerns these
documents; readers merge (``sources.layers``). The documents' table is written last and names the states of the other
two that belong to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import fts_tokens
from codeloom.operators import fts
from codeloom.sources.layers import Layered, buckets_of, hash_bucket
from codeloom.sources.shared_files import delete
from codeloom.sources.staging import new_path

BUCKETS = 32
#: Documents of a span.
SPAN = 32
#: Tokens whose documents one task takes apart into terms.
PORTION = 1 << 19
#: Spans whose documents are scored first.
PROBED = 8


@dataclass
class Counts:
    """What a ranked query read: spans with any of its terms, and spans whose documents were scored."""

    spans: int = 0
    scored: int = 0
    floor: float = field(default=0.0)


def length_class(n_tokens: Column) -> Column:
    """Four classes for each doubling of the length."""
    return F.floor(4 * F.log2(n_tokens + 1)).cast("int")


def _weighted(tf: str, weights: dict[str, float]) -> Column:
    return reduce(Column.__add__, [F.get(tf, F.lit(i)) * float(weights.get(f, 1.0)) for i, f in enumerate(fts.WEIGHTS)])


def _pack(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term", "span").agg(
        F.array(*[F.max(F.get("tf", F.lit(i))) for i in range(len(fts.WEIGHTS))]).alias("most"),
        F.max(_weighted("tf", fts.WEIGHTS)).alias("heaviest"),
        F.min("n_tokens").alias("shortest"),
        F.count("*").alias("n"),
        F.collect_list(F.struct("node_id", "kind", "n_tokens", "tf")).alias("documents"),  # a span's: SPAN or so
    )


def _unpack(blocks: DataFrame) -> DataFrame:
    return blocks.select("term", "span", F.explode("documents").alias("d")).select("term", "span", "d.*")


class TextIndex:
    """Postings, documents and counts of a corpus below ``folder``. Fields are those of ``fts.WEIGHTS``, or some of them."""

    def __init__(self, spark: SparkSession, folder: str, fields: tuple[str, ...] = tuple(fts.WEIGHTS)):
        self.spark, self.fields = spark, fields
        self.postings = Layered(spark, f"{folder}/postings", ["node_id"], hash_bucket("term", BUCKETS), _pack, _unpack, placed=True)
        self.documents = Layered(spark, f"{folder}/documents", ["node_id"], hash_bucket("node_id", BUCKETS))
        self.counts = Layered(spark, f"{folder}/counts", ["term"], hash_bucket("term", BUCKETS))

    def exists(self) -> bool:
        return self.documents.exists()

    # ---- writing --------------------------------------------------------------------------------

    def _rows(self, documents: DataFrame) -> tuple[DataFrame, str]:
        """Tokens of ``documents`` as ``fts.index_documents`` gives them, and the path that they are read from: a row per node with
        those of each field in a string, parted by blanks, and their number. Nothing is shuffled unless rows share a node."""
        path = new_path(self.spark, "tokens")
        documents = fts.one_row_each(documents)
        forms = fts.word_forms(documents) if "morph" in self.fields else documents
        said = [F.col("f_morph") if f == "morph" else fts_tokens(F.col(f"f_{f}")) for f in self.fields]
        rows = forms.select("node_id", "kind", F.array(*[F.array_join(x, " ") for x in said]).alias("said"), reduce(Column.__add__, map(F.size, said)).cast("long").alias("n_tokens"))
        rows.where("n_tokens > 0").write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), path

    def _lengths(self, rows: DataFrame) -> DataFrame:
        """A row per node with length and terms."""
        terms = F.filter(F.array_distinct(F.split(F.array_join("said", " "), " ")), lambda t: t != "")
        return rows.select("node_id", "kind", "n_tokens", terms.alias("terms"))

    def _spanned(self, rows: DataFrame, dealt: dict[int, int], n_tokens: int) -> DataFrame:
        """A row per node and term of it, with its frequency in each field. A span's documents come together before they are taken
        apart into terms, so that their blocks are made where they are."""
        classes = F.create_map(*[F.lit(x) for kv in sorted(dealt.items()) for x in kv]) if dealt else F.create_map().cast("map<int,int>")
        c = length_class(F.col("n_tokens"))
        span = c.cast("long") * (1 << 32) + F.pmod(F.xxhash64("node_id"), F.coalesce(F.try_element_at(classes, c), F.lit(1)))
        held = rows.withColumn("span", span).repartition(max(1, math.ceil(n_tokens / PORTION)), "span")
        flat = held.select("span", "node_id", "kind", "n_tokens", F.posexplode("said").alias("place", "text"))
        flat = flat.select("span", "node_id", "kind", "n_tokens", "place", F.explode(F.split("text", " ")).alias("term")).where("term <> ''")
        tf = [F.count_if(F.col("place") == self.fields.index(f)).cast("int") if f in self.fields else F.lit(0) for f in fts.WEIGHTS]
        return flat.groupBy("term", "span", "node_id", "kind", "n_tokens").agg(F.array(*tf).alias("tf"))

    def build(self, documents: DataFrame) -> None:
        """Index ``documents`` in place of all that was."""
        rows, path = self._rows(documents)
        by_class = rows.groupBy(length_class(F.col("n_tokens")).alias("c")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()  # a few dozen classes
        dealt, n_tokens = {r.c: math.ceil(r.n / SPAN) for r in by_class}, sum(r.t for r in by_class)
        postings = self.postings.write(self._spanned(rows, dealt, n_tokens))
        counts = self.counts.write(self.postings.read(packed=True, number=postings).groupBy("term").agg(F.sum("n").alias("df")))
        self.documents.write(self._lengths(rows), postings=postings, counts=counts, dealt=sorted(dealt.items()), n_docs=sum(r.n for r in by_class), n_tokens=n_tokens)
        delete(self.spark, path)

    def update(self, documents: DataFrame, gone: DataFrame | None = None) -> None:
        """``documents`` in place of those with the same ``node_id``, and those of ``gone`` (node_id) away."""
        if not self.exists():
            return self.build(documents)
        meta = self.documents.state()["meta"]
        rows, path = self._rows(documents)
        lengths = self._lengths(rows)
        keys = documents.select("node_id") if gone is None else documents.select("node_id").unionByName(gone.select("node_id"))
        keys = keys.distinct()
        before = self.documents.read().join(keys, "node_id", "left_semi")
        signed = before.select(F.explode("terms").alias("term"), F.lit(-1).alias("d")).unionByName(lengths.select(F.explode("terms").alias("term"), F.lit(1).alias("d")))
        moved = signed.groupBy("term").agg(F.sum("d").alias("d")).where("d <> 0")
        kept = self.counts.read(number=meta["counts"]).join(moved.select("term"), "term", "left_semi").select("term", F.col("df").alias("d"))
        now = moved.unionByName(kept).groupBy("term").agg(F.sum("d").alias("df"))
        old, new = (x.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first() for x in (before, rows))
        counts = self.counts.change(now.where("df > 0"), now.select("term"), meta["counts"])
        postings = self.postings.change(self._spanned(rows, dict(meta["dealt"]), new.t), keys, meta["postings"])
        self.documents.change(lengths, keys, postings=postings, counts=counts, n_docs=meta["n_docs"] - old.n + new.n, n_tokens=meta["n_tokens"] - old.t + new.t)
        delete(self.spark, path)

    # ---- reading --------------------------------------------------------------------------------

    def totals(self) -> tuple[int, int]:
        """(documents with tokens, tokens)."""
        meta = self.documents.state()["meta"]
        return meta["n_docs"], meta["n_tokens"]

    def frequencies(self) -> DataFrame:
        """(term, df) of all terms."""
        return self.counts.read(number=self.documents.meta("counts"))

    def of_terms(self, terms: list[str], packed: bool = False) -> DataFrame:
        """Postings of ``terms``, from their folders alone."""
        number = self.documents.meta("postings")
        return self.postings.read(buckets_of(self.spark, terms, BUCKETS), packed, number).where(F.col("term").isin(sorted(set(terms))))

    def _idf(self, terms: list[str]) -> dict[str, float]:
        n, _ = self.totals()
        found = self.counts.read(buckets_of(self.spark, terms, BUCKETS), number=self.documents.meta("counts")).where(F.col("term").isin(sorted(set(terms)))).collect()  # a query's terms
        idf = {r.term: math.log((n - r.df + 0.5) / (r.df + 0.5)) for r in found}
        return {t: x if x > 0 else 1e-6 for t, x in idf.items()}

    def _part(self, idf: dict[str, float], w: Column, n_tokens: str) -> Column:
        n, total = self.totals()
        by_term = F.create_map(*[F.lit(x) for kv in sorted(idf.items()) for x in kv])
        return F.element_at(by_term, F.col("term")) * w / (w + fts.K1 * (1 - fts.B + fts.B * F.col(n_tokens) / (total / n))) * (fts.K1 + 1)

    def bm25(self, terms: list[str], weights: dict[str, float] | None = None, kind: str | None = None, spans: DataFrame | None = None) -> DataFrame:
        """(node_id, bm25) of all documents with any of ``terms``, or those of ``spans`` (span)."""
        idf = self._idf(terms)
        if not idf:
            return self.spark.createDataFrame([], "node_id string, bm25 double")
        # a span's documents are taken apart after the spans are chosen
        hits = self.of_terms(list(idf)) if spans is None else self._of_spans(list(idf), spans)
        hits = hits.where(F.col("kind") == kind) if kind else hits
        return hits.groupBy("node_id").agg(F.sum(self._part(idf, _weighted("tf", weights or fts.WEIGHTS), "n_tokens")).alias("bm25"))

    def _of_spans(self, terms: list[str], spans: DataFrame) -> DataFrame:
        chosen = Layered(self.spark, self.postings.folder, ["node_id"], self.postings.bucket, _pack, lambda blocks: _unpack(blocks.join(spans, "span", "left_semi")))
        return chosen.read(buckets_of(self.spark, terms, BUCKETS), number=self.documents.meta("postings")).where(F.col("term").isin(sorted(set(terms))))

    def top(self, terms: list[str], k: int, weights: dict[str, float] | None = None, kind: str | None = None, within: float = 0.0, probed: int = PROBED) -> tuple[DataFrame, Counts]:
        """(node_id, bm25) of the ``k`` best documents and of all at most ``within`` below the last of them, and what was read."""
        weights, idf = weights or fts.WEIGHTS, self._idf(terms)
        if not idf or k < 1:
            return self.spark.createDataFrame([], "node_id string, bm25 double"), Counts()
        blocks = self.of_terms(list(idf), packed=True).select("term", "span", "most", "heaviest", "shortest")  # the documents' column is not read
        # other weights than the usual ones are bounded field by field
        w = F.col("heaviest") if weights == fts.WEIGHTS else _weighted("most", weights)
        # layers have blocks of their own: a term counts once in a span, with the highest of them
        bound = blocks.groupBy("span", "term").agg(F.max(self._part(idf, w, "shortest")).alias("b")).groupBy("span").agg(F.sum("b").alias("bound"))
        path = new_path(self.spark, "spans")
        bound.write.parquet(path)
        bounds = self.spark.read.schema(bound.schema).parquet(path)
        first = bounds.orderBy(F.desc("bound"), "span").limit(probed).select("span")
        floor_rows = self.bm25(terms, weights, kind, first).orderBy(F.desc("bm25")).limit(k).select("bm25").collect()  # k numbers
        floor = floor_rows[-1].bm25 * (1 - 1e-12) - within if len(floor_rows) == k else 0.0
        chosen = bounds.where(F.col("bound") >= floor * (1 - 1e-9)).select("span")
        scored = self.bm25(terms, weights, kind, chosen)
        kth = scored.where(F.col("bm25") >= floor).orderBy(F.desc("bm25")).limit(k).agg(F.min("bm25") - within).scalar()
        return scored.where(F.col("bm25") >= kth), Counts(bounds.count(), chosen.count(), floor)
