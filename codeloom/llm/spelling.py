"""Spelling variants: words one edit apart, found by rolling-hash deletion keys.

Two words differ by one replaced letter if they are equal once the letter of one place is deleted from both, and
by one inserted letter if one of them is the other with a letter deleted. So each word has a key for each of its
letters, the hash of what is left without it, and one for itself. Prefix and suffix sums of a polynomial over a
whole batch's letters give all of them in NumPy, as 64-bit integers.

Spark parts the keys by radix and sorts each part. A task streams through its part: rows of one key are a
group, which is checked on the strings and falls apart where different strings share a hash. A group is as
small as the strings that one inserted letter can make, so it is never gathered without a bound; it gives for each of
its words how many others are near and the best of them, never the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import discard, mix64, stage

#: Fixed value: what a word consists of. All of it lies in Latin-1, a byte a letter.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")
#: Characters of a text, and different words of a task, that are held at once.
BLOCK, HELD = 1 << 22, 200_000


def _blocks(text: str) -> Iterator[str]:
    """``text`` in parts that no run crosses."""
    at = 0
    while at < len(text):
        end = _OTHER.search(text, at + BLOCK) if len(text) - at > BLOCK else None
        stop = end.end() if end else len(text)
        yield text[at:stop] if at or stop < len(text) else text
        at = stop


def _misspelt(word: bytes, doc: int, every: int) -> bytes:
    """``word`` without one letter, if the checksum that begins with ``doc`` says so."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), doc)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, least_letters: int = 5, least_count: int = 3, every: int = 0) -> DataFrame:
    """(word, n): the texts' runs of letters, A-Z in lower case, with at least so many letters and occurrences.

    With ``every``, a document's word loses a letter wherever ``every`` divides the CRC-32 of ``doc_id:word`` in
    UTF-8, at the place that this number modulo the word's length names. A null doc_id is empty there.
    """

    def run(batches):
        counts: Counter[bytes] = Counter()

        def flush():
            words = [w.decode("latin-1") for w in counts]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                doc = zlib.crc32(f"{name.as_py() if name.is_valid else ''}:".encode())
                for block in _blocks(text.as_py() or ""):
                    found = Counter(" ".join(RUN.findall(block)).encode("latin-1").lower().split())
                    for word, n in found.items():
                        if len(word) >= least_letters:
                            word = _misspelt(word, doc, every) if every else word
                            if len(word) >= least_letters:
                                counts[word] += n
                    if len(counts) > HELD:
                        yield flush()
        yield flush()

    parts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x94D049BB133111EB))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word's index, place, key): place -1 is the whole word, others are the deleted letter's."""
    raw = [w.encode("latin-1") for w in words]
    size = np.array([len(w) for w in raw], np.int64)
    letters = np.frombuffer(b"".join(raw), np.uint8)
    n, start = len(letters), np.cumsum(size) - size
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[letters] * _powers(_BASE, n), out=sums[1:])
        back = _powers(_INVERSE, n + 1)
        of = np.repeat(np.arange(len(words)), size)
        at = np.arange(n)
        # the prefix as it is, and the suffix moved one letter to the left
        left = (sums[at] - sums[start[of]]) + (sums[start[of] + size[of]] - sums[at + 1]) * _INVERSE
        short = mix64(left * back[start[of]] + (size[of] - 1).astype(np.uint64))
        whole = mix64((sums[start + size] - sums[start]) * back[start] + size.astype(np.uint64))
    index = np.concatenate([np.arange(len(words)), of])
    place = np.concatenate([np.full(len(words), -1), at - start[of]])
    return index, place, np.concatenate([whole, short]).view(np.int64)


def _keys(words: DataFrame) -> DataFrame:
    """(key, word, n, place) of every word."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                index, place, key = deletion_keys(batch.column(0).to_pylist())
                index = pa.array(index)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(index), batch.column(1).take(index), pa.array(place.astype(np.int32))], names=["key", "word", "n", "place"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long, place int")


Row = tuple[str, int, int]
Near = tuple[str, int, int, str]


def _best(rows: list[Row]) -> list[Row]:
    """The two best of ``rows``: most occurrences first, ties in the order of code points."""
    return sorted(rows, key=lambda r: (-r[1], r[0]))[:2]


def near_in_group(rows: list[Row]) -> Iterator[Near]:
    """(word, near words, best one's n, best one) of the rows (word, n, place) of one key; strings decide."""
    apart: dict[str, list[Row]] = {}
    for r in rows:
        word, _, place = r
        apart.setdefault(word if place < 0 else word[:place] + word[place + 1 :], []).append(r)
    for same in apart.values():
        if len(same) < 2:
            continue
        whole = [r for r in same if r[2] < 0]
        longer = list({r[0]: r for r in same if r[2] >= 0}.values())
        if whole and longer:
            (word, n, _), top = whole[0], _best(longer)[0]
            yield word, len(longer), top[1], top[0]
            for r in longer:
                yield r[0], 1, n, word
        by_place: dict[int, list[Row]] = {}
        for r in same:
            if r[2] >= 0:
                by_place.setdefault(r[2], []).append(r)
        for alike in by_place.values():
            if len(alike) > 1:
                first, second = _best(alike)
                for r in alike:
                    top = second if r[0] == first[0] else first
                    yield r[0], len(alike) - 1, top[1], top[0]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, near_n, near): how many words are one edit away, and the one of them with largest n.

    ``words`` has (word, n), each word once, letters of Latin-1. Ties go to the first in order of code points.
    """
    sorted_keys = _keys(words).repartition("key").sortWithinPartitions("key")

    def run(batches):
        keys, rest = np.empty(0, np.int64), pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "place": pa.array([], pa.int32())})

        def groups(key: np.ndarray, table: pa.Table):
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            size = np.diff(edge)
            several = np.flatnonzero(size > 1)
            rows = np.concatenate([np.arange(edge[g], edge[g + 1]) for g in several]) if len(several) else np.empty(0, np.int64)
            taken = table.take(pa.array(rows))
            triples = list(zip(taken.column(0).to_pylist(), taken.column(1).to_pylist(), taken.column(2).to_pylist()))
            out, at = [], 0
            for m in size[several].tolist():
                out += near_in_group(triples[at : at + m])
                at += m
            columns = list(zip(*out)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "near_n", "near"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            rest = pa.concat_tables([rest, pa.Table.from_batches([batch]).drop_columns(["key"])])
            whole = int(np.searchsorted(keys, keys[-1]))  # rows of the last key may go on in the next batch
            if whole:
                yield groups(keys[:whole], rest.slice(0, whole))
                keys, rest = keys[whole:], rest.slice(whole)
        if len(keys):
            yield groups(keys, rest)

    found = sorted_keys.mapInArrow(run, "word string, n_near long, near_n long, near string")
    rows = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("near_n")).alias("less"), "near").alias("best"))
    all_ = rows.unionByName(words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(rows.schema["best"].dataType).alias("best")))
    out = all_.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return out.select("word", "n", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form), which have no circle: the end of each word's chain, by pointer doubling."""
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stage(now.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = step
        if now.where("moved").isEmpty():
            out = now.select("word", "root")
            out._staged_at = now._staged_at
            return out


def variants(docs: DataFrame, least_letters: int = 5, least_count: int = 3, every: int = 0, ratio: int = 2) -> DataFrame:
    """The words of ``docs`` (doc_id, text) with their common spelling: word, n, n_near, form, form_n, root.

    A word's form is its near word (one letter inserted, deleted or replaced) of largest n, the first in order of code points among
    equals, if that is at least ``ratio`` (2 or more) times the word's n; else null. ``root`` ends the chain of forms, the word itself
    without one. Null and empty texts have no words; long ones are read in blocks; repeated rows count each; a null
    doc_id is as ``vocabulary`` says; extra columns are ignored; an empty table gives no rows.
    """
    words = stage(vocabulary(docs, least_letters, least_count, every), "spelling-words")
    taken: Column = F.col("near_n") >= ratio * F.col("n")
    near = stage(near_words(words).select("word", "n", "n_near", F.when(taken, F.col("near")).alias("form"), F.when(taken, F.col("near_n")).alias("form_n")), "spelling-near")
    discard(words)
    ends = roots(near.where("form is not null"))
    return near.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
