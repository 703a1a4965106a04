"""Cross-site boilerplate lines: HyperLogLog sketches of each line's sites, exact counts where in doubt.

A line is known by two 64-bit hashes. Per line one aggregation merges the sketches of the sites it
stands on. An estimate well above the threshold settles the line; lines whose estimate lies within
the sketch's error of the threshold get an exact distinct count. Lines on ``min_sites`` sites or
more are boilerplate: the first occurrence (smallest doc_id, then position) stays, so no text is
lost from the corpus, and all other occurrences go.

Long lines repeat by no chance: ``remove_passages`` cuts those that stand in two documents, whatever
their sites. It is for documents without near copies among them, whose texts it would cut down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import chunked_walk, fresh, let, stage

MIN_SITES = 3
#: Shorter lines repeat by chance in ordinary prose, and are left alone.
MIN_WORDS = 3
#: Lines of so many words are passages.
PASSAGE_WORDS = 50
#: 2**8 registers: a relative error of about 1.04 / 16 = 6.5 %.
LOG_K = 8
ERROR = 1.04 / 2 ** (LOG_K / 2)

#: A line near the threshold is counted in so many parts, by a hash of the document.
SALTS = 16

_WORD = r"[^\x20\x09-\x0D]+"


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per line that may be boilerplate: its document, place, site and hashes."""
    return (
        docs.where("doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where(F.col("line").rlike(rf"^[\x20\x09-\x0D]*(?:{_WORD}[\x20\x09-\x0D]+){{{min_words - 1}}}{_WORD}"))
        .select("doc_id", "pos", "source", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))
    )


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """Hashes of the boilerplate lines with their first occurrence: h1, h2, first_doc, first_pos."""
    lines = _lines(docs, min_words)
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("source", F.lit(LOG_K)).alias("sketch"),
        F.min(F.struct("doc_id", "pos")).alias("first"),
    )
    near = 1 + 3 * ERROR
    spread = stage(
        spread.withColumn("sites", F.hll_sketch_estimate("sketch"))
        .where(F.col("sites") >= int(min_sites / near))
        .select("h1", "h2", "first", (F.col("sites") > min_sites * near).alias("sure")),
        "lines",
    )
    # a line of very many documents is spread over tasks; each of them passes on every site once
    unsure = spread.where("not sure").select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    exact = (
        lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int"))
        .join(unsure, ["h1", "h2", "salt"], "left_semi")
        .select("h1", "h2", "source")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("source").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    settled = spread.where("sure").select("h1", "h2", "first").unionByName(spread.where("not sure").join(exact, ["h1", "h2"]).select("h1", "h2", "first"))
    return settled.select("h1", "h2", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with boilerplate lines cut out of ``text``, and ``n_lines``, ``n_removed`` (int); where ``docs``
    has these names, with underscores in front of the new ones.

    Null texts stay null, with 0 lines; an empty text is one empty line. A null source is no site.
    Rows with a null doc_id take no part and come back whole. Rows that share a doc_id lose lines
    at the same places. All columns of ``docs`` stay; an empty table gives no rows.
    """
    return _cut(docs, stage(boilerplate(docs, min_sites, min_words), "boilerplate"), min_words)


def remove_passages(docs: DataFrame, min_words: int = PASSAGE_WORDS) -> DataFrame:
    """``remove_boilerplate`` of the lines of ``min_words`` words or more that stand in two documents or more."""
    spread = _lines(docs, min_words).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max("doc_id").alias("last"))
    known = spread.where("first.doc_id < last").select("h1", "h2", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"))
    return _cut(docs, stage(known, "passages"), min_words)


def _cut(docs: DataFrame, known: DataFrame, min_words: int) -> DataFrame:
    """``docs`` without the lines of ``known`` but their first occurrences."""
    doc, gone, n_lines, n_removed = (fresh(docs.columns, c) for c in ("_doc", "_gone", "n_lines", "n_removed"))
    cut = (
        _lines(docs, min_words)
        .drop("source")
        .join(known, ["h1", "h2"])
        .where("doc_id <> first_doc or pos <> first_pos")
        .groupBy("doc_id")
        .agg(F.collect_set("pos").alias(gone))
        .withColumnRenamed("doc_id", doc)
    )
    lines = F.split("text", "\n")

    def kept(places: Column) -> Column:
        """The lines whose number isn't the next of ``places``, which are in order."""

        def step(at: Column, x: Column) -> Column:
            drop = F.coalesce(F.get(places, at) == x.i, F.lit(False))
            return F.struct((at + drop.cast("int")).alias("state"), F.struct(x.line.alias("line"), drop.alias("drop")).alias("out"))

        numbered = F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("i")))
        return F.filter(chunked_walk(numbered, F.lit(0), step, "struct<line:string,drop:boolean>").out, lambda x: ~x.drop)

    cut_text = F.array_join(F.transform(let(F.sort_array(gone), kept), lambda x: x.line), "\n")
    shortened = F.when(F.col(gone).isNull(), F.col("text")).otherwise(cut_text)
    return docs.join(cut, F.col("doc_id").cast("long") == F.col(doc), "left").select(
        *[shortened.alias(c) if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col("text").isNotNull(), F.size(lines)).otherwise(0).alias(n_lines),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).alias(n_removed),
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), eligible AS (
  SELECT * FROM lines WHERE regexp_matches(line, '^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+[\x20\x09-\x0D]+){2}[^\x20\x09-\x0D]+')
), bad AS (
  SELECT line, min(struct_pack(d := doc_id, p := pos)) AS first
  FROM eligible GROUP BY line HAVING count(DISTINCT source) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line,
         b.line IS NOT NULL AND (b.first.d <> l.doc_id OR b.first.p <> l.pos) AS gone
  FROM lines l LEFT JOIN bad b ON l.line = b.line
)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines,
       CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""
