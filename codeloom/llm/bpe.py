"""Exact BPE encoding and decoding with a minimal acyclic transducer as its lexicon.

The words that the corpus uses most are encoded once and compiled into a minimal acyclic automaton
over their UTF-8 bytes: words that share an ending share its states. Each accepted word has a rank
(the number of accepted words before it in byte order, summed along its path), which points to its
ids. One task compiles it; every Python worker maps it into memory as a flat file, once. Words that it doesn't
hold are merged exactly by the tokenizer's own merge ranks.

The tokenizer's file is a parameter: JSON of the public ``tokenizers`` library whose model is BPE with
an end-of-word suffix, byte-level alphabet, and a normalizer of NFC, white space and lower case.
"""

from __future__ import annotations

import collections
import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import discard, held_by_worker, stage

#: Bound on the words compiled into the lexicon, most frequent first.
LEXICON_WORDS = 50_000
PLAIN_MARKS = frozenset(",.;:!?|")
#: Entries of a worker's memory of words, which is emptied when full.
REMEMBERED = 300_000


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for letters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The tokenizer: text to words, words to ids by ranked merges, ids to text."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [self.tokens.get(i, "") for i in range(max(self.tokens, default=0) + 1)]
        self.letters = _byte_letters()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words_of = regex.compile(split).findall
        self.special_of = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # white space and split() may differ in these characters, and special tokens are cut out first
        marks = "".join(map(regex.escape, {t[0] for t in self.special})) if self.special else ""
        self.odd = re.compile(f"[\x1c-\x1f\x85{marks}]").search
        self.pairs = PairTable(self)

    def normalize(self, text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        # the library lower-cases letter by letter, without Python's rule for a final sigma
        return text.lower() if "Σ" not in text else "σ".join(x.lower() for x in text.split("Σ"))

    def words(self, text: str) -> list[str]:
        """Words of a text in order; a special token's string is a word of its own."""
        if self.special_of and "<|" in text and (parts := self.special_of.split(text))[1:]:
            return [w for p in parts for w in ([p] if p in self.special else self.words_of(self.normalize(p)))]
        return self.words_of(self.normalize(text))

    def pieces(self, text: str) -> list[str]:
        """A text cut at white space, which no word crosses; where that isn't safe, its words."""
        return self.words(text) if self.odd(text) else text.split()

    def piece_words(self, piece: str) -> list[str]:
        """Words of a piece: letters alone, or letters and one closing mark, need no pattern."""
        if self.letters_only(piece):
            return [piece.lower()]
        if piece[-1:] in PLAIN_MARKS and self.letters_only(piece[:-1]):
            return [piece[:-1].lower(), piece[-1]]
        return [piece] if piece in self.special else self.words_of(self.normalize(piece))

    @staticmethod
    def letters_only(piece: str) -> bool:
        return piece.isalpha() and (piece.isascii() or "\u03a3" not in piece and unicodedata.is_normalized("NFC", piece) and piece.lower().isalpha())

    def merge_all(self, words: list[str]) -> list[bytes]:
        """Ids of many words, as bytes: one merge of each word at a time, for all together; long words singly."""
        out: list = [b""] * len(words)
        raw = [w.encode("utf-8", "replace") for w in words]
        short = [i for i, b in enumerate(raw) if 0 < len(b) <= 48 and words[i] not in self.special]
        for i in set(range(len(words))).difference(short):
            out[i] = np.array(self.merge(words[i]), "<u4").tobytes() if raw[i] else b""
        short.sort(key=lambda i: len(raw[i]))
        for at in range(0, len(short), 8192):
            rows = short[at : at + 8192]
            width = len(raw[rows[-1]])
            size = np.array([len(raw[i]) for i in rows])
            token = self.pairs.letters[np.frombuffer(b"".join([raw[i].ljust(width, b"\0") for i in rows]), np.uint8).reshape(-1, width)]
            token[np.arange(width) >= size[:, None]] = -1
            last = np.array([raw[i][-1] for i in rows])
            token[np.arange(len(rows)), size - 1] = self.pairs.last_letters[last]
            self.pairs.merge_rows(token, rows, out)
        return out

    def merge(self, word: str) -> list[int]:
        """Ids of a word: the best-ranked neighbouring pair merges first, the leftmost of equals."""
        if word in self.special:
            return [self.special[word]]
        parts = [self.letters[b] for b in word.encode("utf-8", "replace")]
        parts[-1] += self.suffix
        ranks = self.ranks
        if len(parts) > 200:
            parts = self._merge_long(parts)
        while len(parts) > 1:
            best, at = min(((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.vocab[p] for p in parts if p in self.vocab]

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same merges by a heap, for words of great length."""
        n, ranks = len(parts), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if parts[i] else -1
            if j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (p := (parts[a], parts[after[a]])) in ranks:
                    heapq.heappush(heap, (ranks[p], a, p))
        return [p for p in parts if p]

    def decode(self, ids: list[int]) -> str:
        """The tokens of ``ids``, joined by spaces: what a tokenizer without a decoder gives."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


class PairTable:
    """Merge ranks of pairs of ids in an open-addressed table, looked up for whole arrays."""

    NONE = np.int64(1 << 40)

    def __init__(self, bpe: WordBpe):
        vocab = bpe.vocab
        self.letters = np.array([vocab.get(c, -1) for c in bpe.letters], np.int64)
        self.last_letters = np.array([vocab.get(c + bpe.suffix, -1) for c in bpe.letters], np.int64)
        rows = [(vocab[a], vocab[b], r, vocab[a + b]) for (a, b), r in bpe.ranks.items() if a in vocab and b in vocab and a + b in vocab]
        a, b, rank, made = np.array(rows, np.int64).reshape(-1, 4).T
        self.bits = max(4, int(2 * max(1, len(rows))).bit_length() + 1)
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank, self.made = np.full(1 << self.bits, self.NONE), np.zeros(1 << self.bits, np.int64)
        key = a << 24 | b
        at, todo = self._slot(key), np.arange(len(key))
        while len(todo):  # each free slot takes one of the keys that want it, the others go on
            free = todo[self.key[at[todo]] < 0]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.key[at[put]], self.rank[at[put]], self.made[at[put]] = key[put], rank[put], made[put]
            todo = np.setdiff1d(todo, put)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; a slot of rank NONE for pairs that don't merge."""
        key = (left << 24 | right).ravel()
        key[(left.ravel() < 0) | (right.ravel() < 0)] = -2
        at = self._slot(key)
        open_ = np.flatnonzero((self.key[at] != key) & (self.key[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.key[at[open_]]
            open_ = open_[(seen != key[open_]) & (seen >= 0)]
        at[self.key[at] != key] = self._nothing
        return at.reshape(left.shape)

    @property
    def _nothing(self) -> int:
        if not hasattr(self, "_empty"):
            self._empty = int(np.flatnonzero(self.key < 0)[0])
        return self._empty

    def merge_rows(self, token: np.ndarray, places: list[int], out: list[bytes]) -> None:
        """Put the final ids of each row of ``token`` (padded by -1) at its place of ``out``."""
        rows = np.array(places)
        slot = self.find(token[:, :-1], token[:, 1:])
        while len(rows):
            rank = self.rank[slot] if slot.shape[1] else np.full((len(rows), 1), self.NONE)
            best = rank.argmin(1)
            here = np.arange(len(rows))
            more = rank[here, best] < self.NONE
            done = token[~more]
            full = done >= 0
            ends = 4 * np.cumsum(full.sum(1))
            flat, begin = done[full].astype("<u4").tobytes(), 0
            for i, end in zip(rows[~more].tolist(), ends.tolist()):
                out[i] = flat[begin:end]
                begin = end
            rows, token, slot, best = rows[more], token[more], slot[more], best[more]
            if not len(rows):
                break
            here = np.arange(len(rows))
            token[here, best] = self.made[slot[here, best]]
            width = token.shape[1]
            take = np.arange(width - 1) + (np.arange(width - 1) > best[:, None])
            token = np.take_along_axis(token, take, 1)
            if width < 3:
                slot = slot[:, :0]
                continue
            take = np.arange(width - 2) + (np.arange(width - 2) >= best[:, None])
            slot = np.take_along_axis(slot, take, 1)
            left = np.maximum(best - 1, 0)
            slot[here, left] = self.find(token[here, left], token[here, left + 1])
            right = np.minimum(best, width - 3)
            slot[here, right] = self.find(token[here, right], token[here, right + 1])


class Lexicon:
    """A minimal acyclic automaton from words to ids, in one flat file.

    Arrays: ``first`` (where a state's arcs begin), ``label`` and ``target`` of arcs, ``skip`` (the
    words accepted through earlier arcs of the state or at it), ``final``, then ``start`` and
    ``ids`` by rank of the word.
    """

    FIELDS = (("first", np.uint32), ("label", np.uint8), ("target", np.uint32), ("skip", np.uint32), ("final", np.uint8), ("start", np.uint32), ("ids", np.uint32))

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self.map, np.uint64, len(self.FIELDS) + 1)
        self.root, at = int(head[-1]), 8 * len(head)
        for (name, kind), n in zip(self.FIELDS, head.tolist()):
            setattr(self, name, np.frombuffer(self.map, kind, n, at))
            if name == "ids":
                self.ids_at = at
            at += -(-n * np.dtype(kind).itemsize // 8) * 8
        owner = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first.astype(np.int64)))
        self._arc = owner * 256 + self.label  # sorted: a state's arcs are in the order of their labels

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> bytes:
        """The file for ``entries``; states with the same future are registered once."""
        words = sorted(entries)
        register: dict[tuple, int] = {}
        states: list[tuple] = []

        def close(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path: list[list] = [[False, []]]
        last = b""
        for word in words:
            same = len(os.path.commonprefix([last, word]))
            while len(path) > same + 1:
                done = close(path.pop())
                path[-1][1].append((last[len(path) - 1], done))
            path += [[False, []] for _ in word[same:]]
            path[-1][0] = True
            last = word
        while len(path) > 1:
            done = close(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        root = close(path.pop())
        accepted: list[int] = []
        first, label, target, skip = [0], [], [], []
        for final, arcs in states:  # targets come before the states that point to them
            n = int(final)
            for letter, to in arcs:
                label.append(letter)
                target.append(to)
                skip.append(n)
                n += accepted[to]
            first.append(len(label))
            accepted.append(n)
        ids = [entries[w] for w in words]
        arrays = {"first": first, "label": label, "target": target, "skip": skip, "final": [int(f) for f, _ in states], "start": np.cumsum([0, *map(len, ids)]), "ids": [i for x in ids for i in x]}
        out = [np.array([*(len(arrays[n]) for n, _ in cls.FIELDS), root], np.uint64).tobytes()]
        for name, kind in cls.FIELDS:
            raw = np.asarray(arrays[name], kind).tobytes()
            out.append(raw + b"\0" * (-len(raw) % 8))
        return b"".join(out)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 for words that are not held; all words take a step at a time."""
        n = len(words)
        rank = np.zeros(n, np.int64)
        if not n or not len(self._arc):
            return rank - 1
        size = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        state, alive = np.full(n, self.root, np.int64), np.arange(n)
        rank[:] = -1
        value = np.zeros(n, np.int64)
        step = 0
        while len(alive):
            ended = size[alive] == step
            done = alive[ended]
            held = done[self.final[state[done]] > 0]
            rank[held] = value[held]
            alive = alive[~ended]
            if not len(alive):
                break
            key = state[alive] * 256 + flat[begin[alive] + step]
            arc = np.searchsorted(self._arc, key)
            arc[arc == len(self._arc)] = 0
            ok = self._arc[arc] == key
            alive, arc = alive[ok], arc[ok]
            value[alive] += self.skip[arc]
            state[alive] = self.target[arc]
            step += 1
        return rank


class Encoder:
    """A worker's encoder: the mapped lexicon, exact merges for other words, and a bounded memory.

    No word crosses white space, so the memory is by the pieces between white space.
    """

    def __init__(self, bpe: WordBpe, lexicon: bytes):
        self.bpe, self.known, self.ids, self.texts = bpe, {}, [], []
        fd, path = tempfile.mkstemp(suffix=".fsa")
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(lexicon)
            self.lexicon = Lexicon(path)
        finally:
            os.unlink(path)  # the mapping stays

    def look_up(self, pieces: list[str]) -> None:
        """Enter ``pieces`` in the memory: ids as bytes, and the text that they decode to."""
        split = [self.bpe.piece_words(p) for p in pieces]
        words = list({w for ws in split for w in ws})
        ranks = self.lexicon.ranks([w.encode("utf-8", "replace") for w in words])
        start, at, held = self.lexicon.start, self.lexicon.ids_at, self.lexicon.map
        begins, ends = (at + 4 * start[ranks].astype(np.int64)).tolist(), (at + 4 * start[ranks + 1].astype(np.int64)).tolist()
        got = [held[b:e] if r >= 0 else None for r, b, e in zip(ranks.tolist(), begins, ends)]
        unseen = [i for i, g in enumerate(got) if g is None]
        for i, ids in zip(unseen, self.bpe.merge_all([words[i] for i in unseen])):
            got[i] = ids
        named, flat = self.bpe.names.__getitem__, np.frombuffer(b"".join(got), "<u4").tolist()
        pair, begin = {}, 0
        for w, ids in zip(words, got):
            end = begin + len(ids) // 4
            pair[w] = (ids, " ".join(map(named, flat[begin:end])))
            begin = end
        for p, ws in zip(pieces, split):
            self.known[p] = len(self.ids)
            if len(ws) == 1:
                ids, text = pair[ws[0]]
            else:
                some = [pair[w] for w in ws]
                ids, text = b"".join([g[0] for g in some]), " ".join([g[1] for g in some if g[0]])
            self.ids.append(ids)
            self.texts.append(text)

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Of each text the ids as little-endian unsigned 32-bit integers, and their decoded text."""
        if len(self.known) > REMEMBERED:
            self.known, self.ids, self.texts = {}, [], []
        split = [self.bpe.pieces(t) for t in texts]
        places = [list(map(self.known.get, pieces)) for pieces in split]
        new = set()
        for pieces, at in zip(split, places):
            if None in at:
                new.update([p for p, i in zip(pieces, at) if i is None])
        if new:
            self.look_up(list(new))
            places = [list(map(self.known.get, pieces)) if None in at else at for pieces, at in zip(split, places)]
        ids, text = self.ids.__getitem__, self.texts.__getitem__
        return [(b"".join(map(ids, at)), " ".join(filter(None, map(text, at)))) for at in places]


#: Characters of text that a worker splits at a time.
PORTION = 1 << 20


def portions(column) -> list[list[str]]:
    """The texts of an Arrow column (null: empty) in lists of about ``PORTION`` characters."""
    now, size = [], 0
    for text in column:
        now.append(text.as_py() or "")
        size += len(now[-1])
        if size >= PORTION:
            yield now
            now, size = [], 0
    if now:
        yield now


def word_counts(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(word, n) of all texts of ``docs``, staged.

    Each task counts its own pieces first and passes on a bounded part at a time, so a frequent piece
    is a few rows and not a row for each use; a piece is cut into words once, when its count is known.
    """

    def pieces(batches):
        bpe, counts = tokenizer.here(), collections.Counter()

        def counted():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["piece", "n"])

        for batch in batches:
            for texts in portions(batch.column(0)):
                for text in texts:
                    counts.update(bpe.pieces(text))
                if len(counts) > REMEMBERED:
                    yield counted()
                    counts = collections.Counter()
        yield counted()

    def words(batches):
        bpe = tokenizer.here()
        for batch in batches:
            counts = collections.Counter()
            for p, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in bpe.piece_words(p):
                    counts[w] += n
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(pieces, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return stage(found.mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "bpe-words")


#: Counts are sorted into so many bins for each doubling.
BINS = 32


def frequent_words(counts: DataFrame, limit: int = LEXICON_WORDS) -> DataFrame:
    """The words (word) in the highest bins of ``counts`` (word, n), as many whole bins as have at most ``limit`` words.

    A histogram of at most 64 * ``BINS`` rows finds the lowest of these bins, so no task sorts or sends
    words that don't go into the lexicon.
    """
    bin_of = F.floor(F.log2(F.col("n").cast("double")) * BINS).cast("int")
    histogram = counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("words"))
    upto = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    lowest = histogram.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") <= limit).agg(F.min("bin")).first()[0]
    return counts.where(bin_of >= lowest if lowest is not None else F.lit(False)).select("word")


def load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Tokenizer:
    """A tokenizer's file on its way to the workers, each of which reads it once."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            self.shared = spark.sparkContext.broadcast(f.read())
        self.token = uuid.uuid4().hex

    def here(self) -> WordBpe:
        return held_by_worker(self.token, lambda: WordBpe(json.loads(self.shared.value)))


def compiled(words: DataFrame, tokenizer: Tokenizer) -> bytes:
    """The lexicon of ``words`` (word; a bounded number), compiled by one task."""

    def run(batches):
        bpe = tokenizer.here()
        all_words = [w for batch in batches for w in batch.column(0).to_pylist()]
        ids = bpe.merge_all(all_words)
        entries = {w.encode("utf-8", "replace"): np.frombuffer(i, "<u4").tolist() for w, i in zip(all_words, ids)}
        yield pa.RecordBatch.from_arrays([pa.array([Lexicon.build(entries)], pa.binary())], names=["lexicon"])

    got = words.coalesce(1).mapInArrow(run, "lexicon binary").first()
    return got.lexicon if got else Lexicon.build({})


def encode(docs: DataFrame, tokenizer: str, lexicon_words: int = LEXICON_WORDS, with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): n_tokens, ids_sha256, decoded_sha256; with
    ``with_ids`` also ids (array<int>) and decoded; then the columns of ``docs`` that ``keep`` names.

    A null or empty text has no tokens, and decodes to the empty string. Special tokens' strings in
    a text are special tokens, as in the library. Repeated rows are encoded each; other columns are
    ignored; an empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    shared = Tokenizer(docs.sparkSession, tokenizer)
    counts = word_counts(docs, shared)
    lexicon, token = sc.broadcast(compiled(frequent_words(counts, lexicon_words), shared)), uuid.uuid4().hex
    discard(counts)

    def run(batches):
        encoder = held_by_worker(token, lambda: Encoder(WordBpe(json.loads(shared.shared.value)), lexicon.value))
        for batch in batches:
            n, ids_sha, text_sha, ids, texts = [], [], [], [], []
            for some in portions(batch.column(1)):
                for raw, decoded in encoder.encode_all(some):
                    n.append(len(raw) // 4)
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                        texts.append(decoded)
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            more = [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())] if with_ids else []
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out) + len(more)]
            yield pa.RecordBatch.from_arrays(out + more + batch.columns[2:], names=[*names, *keep])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    schema += "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep).mapInArrow(run, schema)
