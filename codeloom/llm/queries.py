"""The corpus queries: thin readers of the operators' results, over whole tables.

Nulls, empty and very long texts, ties, repeated rows, empty tables and further columns are as the
operators' docstrings say: a query adds no rule of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import ball_kmeans, bpe, embed_dedup, html_extract, line_dedup, minhash, mixing, pii, secrets, spelling, topk, toxicity, warc
from codeloom.llm.common import new_path

#: Target weights of the mixture by source; a source not named has weight 1.
WEIGHTS = {f"src{i}": 1 + i % 4 for i in range(20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.index(spark, path).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block and its slot in the mixture of sources."""
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS).select("doc_id", "source", "block", "slot", "place")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at a similarity of 0.8 or more over 2-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: named patterns, and tokens that test as random."""
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents")))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return topk.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op7_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked at a cosine of 0.9 or more."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; ``toxic`` is the decision by its language's threshold."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic"
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that stand on three sites or more, as a digest."""
    out = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens and the text they decode to, as digests."""
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster of 40, by exact k-means of five rounds."""
    return ball_kmeans.cluster(table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents and their common spelling; where 97 divides a word's checksum it loses a letter first."""
    return spelling.variants(table(spark, sf_dir, "documents"), least_letters=5, least_count=3, every=97, ratio=2)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base patterns, and what trusted contexts discover."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_mixing": op2_mixing,
        "op3_html": op3_html,
        "op4_minhash": op4_minhash,
        "op5_secrets": op5_secrets,
        "op6_topk": op6_topk,
        "op7_embed_dedup": op7_embed_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_line_dedup": op9_line_dedup,
        "op10_bpe": op10_bpe,
        "op11_ball_kmeans": op11_ball_kmeans,
        "op12_spelling": op12_spelling,
        "op13_pii": op13_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.ORACLE,
        "op2_mixing": mixing.ORACLE,
        "op6_topk": topk.ORACLE,
        "op9_line_dedup": line_dedup.ORACLE,
        "op11_ball_kmeans": ball_kmeans.oracle(),
    }
