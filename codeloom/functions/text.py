"""Tokenizers, term statistics and query expansion.

Tokenizers are Column expressions that stay in the JVM. Query-side expansion is plain Python: a query is
a few words. Document-side morphology runs over the distinct vocabulary and is joined back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.lexicon import DOUBLED, ENDINGS, FAMILIES, NAME_STOPWORDS, STOPWORDS, SUFFIXES, TERM_STOPWORDS, THESAURUS, VECTOR_STOPWORDS


def _tokens(c: Column, separators: str, least: int) -> Column:
    spaced = F.translate(c, separators, " " * len(separators))
    split = F.regexp_replace(spaced, "([a-z0-9])([A-Z])", "$1 $2")
    found = F.regexp_extract_all(split, F.lit("[A-Za-z][A-Za-z0-9]{%d,}" % (least - 1)), 0)
    return F.transform(found, lambda x: F.lower(x))


def without(c: Column, words: tuple[str, ...]) -> Column:
    return F.filter(c, lambda x: ~x.isin(*words))


def identifier_tokens(c: Column) -> Column:
    """Words of an identifier, path or text, two letters or more, lower-cased after the split."""
    return _tokens(c, "_-/.", 2)


def term_tokens(c: Column) -> Column:
    return without(_tokens(c, "_", 3), TERM_STOPWORDS)


def vector_tokens(c: Column) -> Column:
    return without(_tokens(c, "_-/", 2), VECTOR_STOPWORDS)


def name_terms(c: Column) -> Column:
    return F.array_distinct(without(_tokens(c, "_-/", 3), NAME_STOPWORDS))


def bag_terms(c: Column) -> Column:
    """Terms of the sparse cosine: three letters or more, without stopwords."""
    return without(_tokens(c, "_-/", 3), STOPWORDS)


def query_tokens(c: Column) -> Column:
    return without(_tokens(c, "_.", 2), STOPWORDS)


def fts_text(c: Column) -> Column:
    """Text as it is indexed: separators blanked, and the split identifiers beside it if they differ."""
    value = F.translate(c, "/.-", "   ")
    split = F.regexp_replace(F.translate(value, "_", " "), "([a-z0-9])([A-Z])", "$1 $2")
    return F.when(split == value, value).otherwise(F.concat_ws(" ", value, split))


def fts_tokens(c: Column) -> Column:
    """Index tokens: runs of letters, digits and ``_``, case folded, diacritics of Latin letters dropped."""
    return F.regexp_extract_all(F.translate(F.lower(c), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}\p{Co}_]+"), 0)


#: Precomposed Latin letters and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def top_terms(docs: DataFrame, limit: int = 250, text: str = "text", key: str = "id") -> DataFrame:
    """``key`` and ``terms``: each document's most frequent terms, then by the term."""
    counts = docs.select(key, F.explode(term_tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "term"))).where(F.col("r") <= limit)
    return ranked.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "term"))), lambda x: x.term).alias("terms"))


def top_terms_inline(c: Column, limit: int = 250) -> Column:
    """The same for one text at a time, without a shuffle."""
    tokens = term_tokens(c)
    counted = F.transform(F.array_distinct(tokens), lambda t: F.struct((-F.size(F.filter(tokens, lambda x: x == t))).alias("n"), t.alias("t")))
    return F.transform(F.slice(F.array_sort(counted), 1, limit), lambda x: x.t)


# ---- query side -------------------------------------------------------------------------------


def split_identifier(value: str) -> list[str]:
    spaced = re.sub("([a-z0-9])([A-Z])", r"\1 \2", value.translate(str.maketrans("_-/.", "    ")))
    return [w.lower() for w in re.findall("[A-Za-z][A-Za-z0-9]+", spaced)]


def morphology(term: str) -> list[str]:
    """Forms that a word may be indexed under, in a fixed order."""
    bases = {term, *FAMILIES.get(term, ())}
    bases.update(term[: -len(end)] + put for end, put in SUFFIXES if term.endswith(end) and len(term) > len(end) + 3)
    out: dict[str, None] = {}
    for form in (base + end for base in sorted(bases) for end in ENDINGS):
        for old, new in DOUBLED:
            form = form.replace(old, new)
        if len(form) > 1:
            out[form] = None
    return list(out)


def expand_query(query: str) -> list[str]:
    """Terms of a query: its words' forms and synonyms, without stopwords."""
    out: dict[str, None] = {}
    for word in split_identifier(query):
        if word not in STOPWORDS:
            out.update(dict.fromkeys(x for x in (*morphology(word), *THESAURUS.get(word, ())) if len(x) > 1 and x not in STOPWORDS))
    return list(out)


def reference_terms(query: str) -> list[str]:
    """Words that must all occur for a literal reference."""
    return [w for w in split_identifier(query) if w not in STOPWORDS]


def morphology_table(vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """(token, variant) of each distinct token; rows grow with the vocabulary, not with the corpus."""

    def run(batches):
        for pdf in batches:
            pdf = pdf.assign(variant=[morphology(t) for t in pdf[token]])
            yield pdf.explode("variant")[[token, "variant"]]

    return vocabulary.select(token).distinct().mapInPandas(run, f"{token} string, variant string")
