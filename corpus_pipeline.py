"""The corpus pipeline: toxicity, line dedup, MinHash near-dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; every stage's result is written as Parquet and read again as the next one's ``docs``.
Parquet keeps no order, so the last stage works out the mixture from its rows, or takes the ``slot``
and ``place`` that ``run`` carries to it, and returns its rows in that order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import bpe, line_dedup, minhash, mixing, toxicity
from codeloom.llm.common import discard, stage
from codeloom.llm.queries import WEIGHTS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found on many sites are cut out of all documents but the first that has them."""
    return line_dedup.remove_boilerplate(docs).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, by op4's two-word shingles, which catch more of the
    near copies than five; then passages that other documents repeat are cut out of these."""
    kept = stage(minhash.keep_one_of_each(docs, words=2), "kept")
    return line_dedup.remove_passages(kept).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    return mixing.mixture(docs, WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document: doc_id, n_tokens, and digests of the ids and of the decoded text; in the order of the mixture."""
    mixed = stage(mixing.mix(docs, WEIGHTS), "mixed")
    out = encode_mixed(mixed).drop("slot", "place")
    discard(mixed)
    return out


def encode_mixed(mixed: DataFrame) -> DataFrame:
    """``encode`` of documents that have slot and place, which stay, ordered by (slot, place, doc_id)."""
    # written before the sort, which would otherwise encode twice to find its ranges
    tokens = stage(bpe.encode(mixed, public_tokenizers.path("word_bpe_49k.json"), keep=("slot", "place")), "tokens")
    return tokens.orderBy("slot", "place", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL expresses neither the classifier nor the hashing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's columns, and every document's slot and place in the mixture, in that order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-2]:
        before, docs = docs, stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return encode_mixed(stage(mixing.mix(docs, WEIGHTS), "mixing"))
