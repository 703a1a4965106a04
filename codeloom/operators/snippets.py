"""The best window of a text for a query's terms, as full-text engines show it.

A window of ``width`` tokens begins at a hit, moved so that its hits stand in the middle, or at the beginning of the
sentence of a hit. Each different term in it counts 1000 and each repetition 1, the beginning of a sentence 100 and that
of the text 120; the first of equals wins. Without a hit it is the text's beginning. A text is
walked once: the windows that hits begin, and those that their sentences begin, move forward with the hits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.text import ACCENTED, PLAIN

WIDTH = 18
TOKEN = re.compile("[\\w-]+")
_SPACES = " \t\n\r"
_FOLD = str.maketrans(ACCENTED, PLAIN)


class _Window:
    """Hits of a window that only moves forward."""

    def __init__(self, hits: list[tuple[int, str]], width: int):
        self.hits, self.width, self.low, self.high, self.seen = hits, width, 0, 0, Counter()

    def at(self, begin: int) -> tuple[int, int, int, int]:
        """(different terms, hits, first place, place behind the last) of the window that begins at ``begin``."""
        while self.high < len(self.hits) and self.hits[self.high][0] < begin + self.width:
            self.seen[self.hits[self.high][1]] += 1
            self.high += 1
        while self.low < self.high and self.hits[self.low][0] < begin:
            term = self.hits[self.low][1]
            self.seen[term] -= 1
            if not self.seen[term]:
                del self.seen[term]
            self.low += 1
        return len(self.seen), self.high - self.low, self.hits[self.low][0], self.hits[self.high - 1][0] + 1


def best_window(hits: list[tuple[int, str]], sentences: list[int], n_tokens: int, width: int = WIDTH) -> tuple[int, int]:
    """(beginning, score) of the best window. ``hits`` are (place, term) and ``sentences`` the places that begin one, in order."""
    best, begin = 0, 0
    by_hit, by_sentence, s = _Window(hits, width), _Window(hits, width), 0
    for place, _ in hits:
        terms, n, first, last = by_hit.at(place)
        score = 1000 * terms + n - terms
        if score > best:
            moved = first - (width - (last - first)) // 2
            best, begin = score, max(min(moved, n_tokens - width), 0)
        while s + 1 < len(sentences) and sentences[s + 1] <= place:
            s += 1
        if n_tokens > width and sentences and sentences[s] < place and place < sentences[s] + width:
            terms, n, _, _ = by_sentence.at(sentences[s])
            score = 1000 * terms + n - terms + (120 if sentences[s] == 0 else 100)
            if score > best:
                best, begin = score, sentences[s]
    return begin, best


def _begins_sentence(text: str, start: int) -> bool:
    at = start
    while at > 0 and text[at - 1] in _SPACES:
        at -= 1
    return 0 < at < start and text[at - 1] in ".:"


def window_of(text: str, terms: frozenset[str], width: int = WIDTH) -> tuple[int, int, list[tuple[int, int]]]:
    """(beginning, score, spans of the text's tokens)."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    hits = [(i, t) for i, (a, b) in enumerate(spans) if (t := text[a:b].lower().translate(_FOLD)) in terms]
    sentences = [i for i, (a, _) in enumerate(spans) if i == 0 or _begins_sentence(text, a)] if hits else []
    return *best_window(hits, sentences, len(spans), width), spans


def snippet_of(text: str, terms: frozenset[str], width: int = WIDTH, dots: str = " ... ") -> str:
    begin, _, spans = window_of(text, terms, width)
    end = begin + width
    left = 0 if begin == 0 else spans[begin][0]
    return (dots if begin else "") + (text[left : spans[end - 1][1]] + dots if end < len(spans) else text[left:])


def best_snippet(text: Column, terms: list[str], width: int = WIDTH) -> Column:
    """The best window of each text; null for null. For the few rows of a result: texts go through Python in Arrow batches."""
    asked = frozenset(terms)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else snippet_of(t, asked, width))

    return of(text)


def hit_snippet(terms: list[str], meta: str = "meta") -> Column:
    """The best window of the docstring, else of the signature, else of the body: the first that isn't blank."""
    m = F.col(meta)
    return F.coalesce(*[F.nullif(F.trim(best_snippet(x, terms)), F.lit("")) for x in (m.docstring, m.signature, m.body_preview)])


def best_begin(text: Column, terms: list[str], width: int = WIDTH) -> Column:
    """struct(begin, score) of the best window: the number of its first token, from 0."""
    asked = frozenset(terms)

    @F.pandas_udf("begin int, score int")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([window_of(t or "", asked, width)[:2] for t in texts], columns=["begin", "score"]).astype("int32")

    return of(text)
