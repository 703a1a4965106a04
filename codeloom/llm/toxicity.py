"""Toxicity: a small convolutional text classifier, trained in numpy, thresholds by language.

A word's vector is the sum of hashed embeddings of the word and of its first four and six bytes.
Filters of widths 1 to 3 slide over the whole text, the largest response of each filter feeds a
logistic output. All labelled rows are fitted: they are dealt to pieces by their id, every piece moves a copy of the
model over its rows, and after each round an entry is the mean over the pieces that have moved it. Only the text is an
input of a score. The language column is used after scoring alone, to pick the threshold of a decision.
"""

from __future__ import annotations

import pickle
import re
import uuid
from math import log

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import discard, held_by_worker, mix64, stage, without

#: Labelled rows of a piece, about: a bound on nothing but a piece's size, all pieces are fitted.
MAX_ROWS = 8_000
#: Characters that a task holds at once while it fits (at least one whole text); the rest of its piece follows.
MAX_CHARS = 1 << 23
#: Masks of 64 bits that tell which texts may have a label: one for four labels, up to four million labels; beyond, more texts pass.
MAX_MASKS = 1 << 20
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
#: Each round goes twice over what a task holds at once: six times over all rows.
ROUNDS, PASSES, BATCH, RATE = 3, 2, 32, 0.1
#: Zero entries after each text: the widest window fits in, and none that reaches the next text counts.
PAD = max(WIDTHS)
PORTION = 1 << 18
REMEMBERED = 150_000
#: Shapes of filters, biases, output weights and output bias, which lie behind the embeddings in rows of DIM.
SHAPES = [*((k, DIM, FILTERS) for k in WIDTHS), (len(WIDTHS), FILTERS), (len(WIDTHS) * FILTERS,), (1,)]
TAIL = -(-sum(int(np.prod(x)) for x in SHAPES) // DIM)
#: Entries are summed as whole numbers of this fraction, so that a mean doesn't hang on the order of the pieces.
FRACTION = 1 << 32

_words = re.compile(r"\w+").findall


def buckets_of(words: list[str]) -> np.ndarray:
    """Three embedding rows of each word: the word's, and those of its first four and six bytes."""
    raw = [w.encode("utf-8", "replace") for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(starts, size)
    with np.errstate(over="ignore"):
        value = mix64(np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) << np.uint64(32) | place.astype(np.uint64))
        sums = [np.add.reduceat(np.where(place < n, value, np.uint64(0)), starts) for n in (1 << 40, 4, 6)]
        return np.stack([(mix64(x + np.uint64(i)) % np.uint64(BUCKETS)).astype(np.int64) for i, x in enumerate(sums)], 1)


def dense(rows: np.ndarray) -> list[np.ndarray]:
    """Views of filters (one a width), biases, output weights and output bias in the TAIL rows that hold them."""
    flat, out, at = rows.reshape(-1), [], 0
    for shape in SHAPES:
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return out


def beginning(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Values before the first round (embeddings, the dense ones, sums of their squared gradients) and the embeddings' sums."""
    r = np.random.default_rng(seed)
    values = np.zeros((BUCKETS + 2 * TAIL, DIM), np.float32)
    values[:BUCKETS] = r.normal(0, 0.1, (BUCKETS, DIM))
    *w, _, v, _ = dense(values[BUCKETS : BUCKETS + TAIL])
    for x in w:
        x[:] = r.normal(0, 0.5, x.shape)
    v[:] = r.normal(0, 0.3, v.shape)
    values[BUCKETS + TAIL :] = 1e-6
    return values, np.full(BUCKETS, 1e-6, np.float32)


class Model:
    """Embeddings ``e``, filters ``w[k]`` (width, DIM, FILTERS), biases, output weights, thresholds."""

    def __init__(self, values: np.ndarray, constant: float | None = None, thresholds: dict[str, float] | None = None):
        self.values = values[: BUCKETS + TAIL]
        self.e = self.values[:BUCKETS]
        *self.w, self.b, self.v, self.bias = dense(self.values[BUCKETS:])
        self.constant = constant
        self.thresholds = thresholds or {}

    def __reduce__(self):
        return Model, (self.values, self.constant, self.thresholds)

    def projections(self, words: list[str]) -> np.ndarray:
        """Each word's contribution to every filter tap: (words, taps, FILTERS)."""
        x = self.e[buckets_of(words)].sum(1) if words else np.empty((0, DIM), np.float32)
        return np.stack([x @ w[j] for w in self.w for j in range(len(w))], 1)

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(pooled), self.constant)
        z = np.maximum(pooled, 0) @ self.v.astype(np.float64) + float(self.bias[0])
        # float32 sums differ in their last digits with what else is in a portion; equal texts score alike
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)

    def pool(self, taps: np.ndarray, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each text; texts are parted by PAD zero entries."""
        out, tap, n = [], 0, len(index)
        near = taps[index]  # a word's taps lie side by side: one visit to memory for all of them
        for k, b in zip(WIDTHS, self.b):
            c = near[:, tap]
            for j in range(1, k):
                c[: n - j] += near[j:, tap + j]
            tap += k
            for j in range(1, k):
                c[np.append(starts[1:], n) - j] = -np.inf
            out.append(np.maximum.reduceat(c, starts, axis=0) + b)
        return np.concatenate(out, 1)


class Scorer:
    """A worker's scorer: remembers the projections of words it has met, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.taps_n = model, sum(WIDTHS)
        self.forget()

    def forget(self) -> None:
        self.known, self.used = {}, 1
        self.taps = np.zeros((1024, self.taps_n, FILTERS), np.float32)  # entry 0 is padding

    def score(self, texts: list[str]) -> np.ndarray:
        if self.used > REMEMBERED:
            self.forget()
        split = [_words(t.lower()) for t in texts]
        places = [list(map(self.known.get, s)) for s in split]
        new = list({w for s, at in zip(split, places) if None in at for w, i in zip(s, at) if i is None})
        if new:
            while self.used + len(new) > len(self.taps):
                self.taps = np.concatenate([self.taps, np.zeros_like(self.taps)])
            self.taps[self.used : self.used + len(new)] = self.model.projections(new)
            self.known.update(zip(new, range(self.used, self.used + len(new))))
            self.used += len(new)
            places = [list(map(self.known.get, s)) if None in at else at for s, at in zip(split, places)]
        size = np.array([len(s) + PAD for s in split])
        starts = np.cumsum(size) - size
        index = np.zeros(int(size.sum()), np.int64)
        for p, at in zip(places, starts.tolist()):
            index[at : at + len(p)] = p
        return self.model.scores(self.model.pool(self.taps, index, starts))


def descend(values: np.ndarray, e_sum: np.ndarray, texts: list[str], labels: np.ndarray, weights: tuple[float, float], rng: np.random.Generator) -> None:
    """Adagrad on the logistic loss, in place; gradients flow through each filter's best window only. ``weights`` are
    those of the labels 0 and 1."""
    model = Model(values)
    vocabulary: dict[str, int] = {}
    docs = []
    for t in texts:
        docs.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in _words(t.lower())] + [0] * PAD, np.int64))
    rows = np.concatenate([np.zeros((1, 3), np.int64), buckets_of(list(vocabulary))]) if vocabulary else np.zeros((1, 3), np.int64)
    live = np.ones((len(rows), 1, 1), np.float32)
    live[0] = 0
    sums = {id(a): s for a, s in zip([*model.w, model.b, model.v, model.bias], dense(values[BUCKETS + TAIL :]))}

    def move(a: np.ndarray, g: np.ndarray) -> None:
        s = sums[id(a)]
        s += g * g
        a -= RATE * g / np.sqrt(s)

    weight = np.where(labels > 0, weights[1], weights[0]).astype(np.float32)
    for _ in range(PASSES):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            index = np.concatenate([docs[i] for i in some])
            size = np.array([len(docs[i]) for i in some])
            starts = np.cumsum(size) - size
            x = (model.e[rows[index]] * live[index]).sum(1)
            pooled, places = [], []
            for k, w in enumerate(model.w):
                c = np.zeros((len(index), FILTERS), np.float32)
                for j in range(len(w)):
                    c[: len(index) - j] += x[j:] @ w[j]
                for j in range(1, k):
                    c[starts + size - j] = -np.inf
                best = np.stack([s + c[s : s + n].argmax(0) for s, n in zip(starts, size)])
                places.append(best)
                pooled.append(np.take_along_axis(c, best, 0) + model.b[k])
            h = np.maximum(np.concatenate(pooled, 1), 0)
            p = 1 / (1 + np.exp(-np.clip(h @ model.v + model.bias[0], -30, 30)))
            g = ((p - labels[some]) * weight[some] / len(some)).astype(np.float32)
            dh = g[:, None] * model.v * (h > 0)
            move(model.v, h.T @ g + 1e-4 * model.v)
            move(model.bias, g.sum(keepdims=True))
            e_rows, e_grads = [], []
            for k, w in enumerate(model.w):
                d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                gw = np.zeros_like(w)
                for j in range(len(w)):
                    t = np.minimum(places[k] + j, len(index) - 1)
                    gw[j] = np.einsum("bfd,bf->df", x[t], d)
                    e_rows.append(index[t].ravel())
                    e_grads.append((d[:, :, None] * w[j].T[None]).reshape(-1, DIM))
                move(w, gw + 1e-4 * w)
            gb = dh.sum(0).reshape(model.b.shape)
            move(model.b, gb)
            r, gr = np.concatenate(e_rows), np.concatenate(e_grads)
            keep = (r > 0) & (np.abs(gr).max(1) > 0)
            if keep.any():
                flat, back = np.unique(rows[r[keep]].ravel(), return_inverse=True)
                total = np.zeros((len(flat), DIM), np.float32)
                np.add.at(total, back, np.repeat(gr[keep], 3, 0))
                e_sum[flat] += (total * total).mean(1)
                model.e[flat] -= RATE * total / np.sqrt(e_sum[flat])[:, None]


def best_cuts(counts: DataFrame, *keys: str) -> DataFrame:
    """Per ``keys`` of ``counts`` (keys, score, n rows, hits of them toxic): the cut with the best F1, among equal ones
    the middle of the widest gap, with all rows and hits."""
    whole = Window.partitionBy(*keys)
    down = whole.orderBy(F.desc("score"))
    below = F.coalesce(F.lead("score").over(down), F.lit(0.0))
    found, asked, of_all, rows = F.sum("hits").over(down), F.sum("n").over(down), F.sum("hits").over(whole), F.sum("n").over(whole)
    steps = counts.select(*keys, F.struct((2 * found / (asked + of_all)).alias("f1"), (F.col("score") - below).alias("gap"), "score").alias("s"), of_all.alias("hits"), rows.alias("n"))
    best = steps.groupBy(*keys, "hits", "n").agg(F.max("s").alias("s"))
    return best.select(*keys, "hits", "n", (F.col("s.score") - F.col("s.gap") / 2).alias("cut"))


def likely(texts: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``texts`` without most rows whose doc_id is not among the ``n`` ``ids``; none of the others goes. The rows meet a
    table of bits, which is bounded however many ids there are, and are not shuffled."""
    slots = 64 * max(1, min(MAX_MASKS, -(-n // 4)))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots))
    masks = ids.select(slot.alias("slot")).selectExpr("slot div 64 as at", "shiftleft(1L, cast(slot % 64 as int)) as bit").groupBy("at").agg(F.bit_or("bit").alias("mask"))
    met = texts.withColumn("slot", slot).join(F.broadcast(masks), F.expr("slot div 64 = at"))
    return met.where("shiftright(mask, cast(slot % 64 as int)) & 1 = 1").select(*texts.columns)


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """All rows to learn from (doc_id, text, lang, toxic, part) in pieces of about ``max_rows``, which are partitions: a
    row's piece and place hang on its id and the number of labels alone."""
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    usable = labels.where("toxic is not null and doc_id is not null").where(part > 0).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", part.alias("part"))
    n = usable.count()
    pieces = max(1, -(-n // max_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    # both sides are dealt to the pieces before they meet, so that a text is shuffled once, and few without a label are
    texts = likely(texts.where("doc_id is not null"), usable, n).repartition(pieces, "doc_id")
    usable = usable.repartition(pieces, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.first("part").alias("part")).where("toxic in (0, 1)")
    rows = texts.join(usable, "doc_id").groupBy("doc_id", "toxic", "part").agg(F.min(F.struct("text", "lang")).alias("r"))
    return rows.select("doc_id", "r.text", "r.lang", "toxic", "part").sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> bytes:
    """A pickled ``Model`` of all labelled rows whose crc32(doc_id) mod 5 is not 0, read whole, in pieces of about
    ``max_rows``; a task holds about ``max_chars`` at once. The driver holds a model and no text.

    Rows of part 1 aren't fitted but calibrate: first the scores, so that 0.5 is the best cut over all, then each
    language's threshold. Labels that are null take no part; of several labels of an id the highest counts, and of rows
    that share an id the one with the smallest text. No labels, or of one class only, give a constant
    score. Extra columns are ignored.
    """
    rows = labelled(docs, labels, max_rows).persist(StorageLevel.DISK_ONLY)
    try:
        fitted = rows.where("part <> 1")
        n, toxic = fitted.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        values, e_sum = beginning()
        if not 0 < toxic < n:
            return pickle.dumps(Model(values, toxic / n if n else 0.0))
        # rare positives weigh as much as all negatives together
        weights = n / (2 * (n - toxic)), n / (2 * toxic)
        for nth in range(ROUNDS):
            values, e_sum = _round(fitted, values, e_sum, weights, nth, max_chars)
        return pickle.dumps(_calibrated(rows.where("part = 1"), Model(values)))
    finally:
        rows.unpersist()


def _round(fitted: DataFrame, values: np.ndarray, e_sum: np.ndarray, weights: tuple[float, float], nth: int, max_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """The model after one round over all pieces."""
    shared = fitted.sparkSession.sparkContext.broadcast((values, e_sum))

    def run(batches):
        values, e_sum = (x.copy() for x in shared.value)
        texts, toxic, size, rng = [], [], 0, None

        def learn():
            # a text without words is held clean unless labels say otherwise: one row among those of the task
            descend(values, e_sum, [*texts, ""], np.array([*toxic, 0], np.float32), weights, rng)
            texts.clear()
            toxic.clear()

        for batch in batches:
            for doc_id, text, y in zip(*(c.to_pylist() for c in batch.columns)):
                rng = rng or np.random.default_rng([7, nth, doc_id % (1 << 63)])
                if texts and size + len(text) > max_chars:
                    learn()
                    size = 0
                texts.append(text)
                toxic.append(y)
                size += len(text)
        if texts:
            learn()
        if rng is None:
            return
        moved = (values != shared.value[0]).any(1)
        moved[:BUCKETS] |= e_sum != shared.value[1]
        moved[BUCKETS:] = True
        place = np.flatnonzero(moved)
        whole = lambda x: pa.array(np.round(x.astype(np.float64) * FRACTION).astype(np.int64))
        sums = np.append(e_sum, np.zeros(2 * TAIL, np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), *(whole(values[place, i]) for i in range(DIM)), whole(sums[place])], names=["place", *entries])

    entries = [f"x{i}" for i in range(DIM + 1)]
    moved = fitted.select("doc_id", "text", "toxic").mapInArrow(run, "place int, " + ", ".join(f"{x} long" for x in entries))
    # a sum of whole numbers over a count: the same whatever came first
    met = moved.groupBy("place").agg(F.count("*").alias("n"), *(F.sum(x).alias(x) for x in entries)).toArrow()
    shared.unpersist()
    place, n = met["place"].to_numpy(), met["n"].to_numpy()
    mean = np.stack([met[x].to_numpy() / (n * float(FRACTION)) for x in entries], 1).astype(np.float32)
    values, e_sum = values.copy(), e_sum.copy()
    values[place] = mean[:, :DIM]
    embedded = place < BUCKETS
    e_sum[place[embedded]] = mean[embedded, DIM]
    return values, e_sum


def _calibrated(held: DataFrame, model: Model) -> Model:
    """``model`` with its bias moved so that 0.5 is the best cut over all of ``held``, and with each language's threshold."""
    shared, token = held.sparkSession.sparkContext.broadcast(pickle.dumps(model)), uuid.uuid4().hex

    def run(batches):
        scorer = held_by_worker(token, lambda: Scorer(pickle.loads(shared.value)))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores_of(scorer, batch.column(1)))], names=["lang", "toxic", "score"])

    # scores have six digits, so there are few different ones however many rows
    scored = held.select("lang", "text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(run, "lang string, toxic long, score double")
    counts = stage(scored.groupBy("lang", "score").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits")), "scores")
    overall = best_cuts(counts.groupBy(F.lit(0).alias("all"), "score").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")), "all").first()
    if overall and 0 < overall.hits < overall.n:
        cut = min(max(overall.cut, 1e-6), 1 - 1e-6)
        model.bias -= np.float32(log(cut / (1 - cut)))
        s = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("score")))
        moved = counts.where("lang is not null").withColumn("score", 1 / (1 + F.exp(F.log(1 - s) - F.log(s) + log(cut / (1 - cut)))))
        # fewer than ten say too little about a language
        model.thresholds = {r.lang: r.cut for r in best_cuts(moved, "lang").where("hits >= 10 and hits < n").orderBy("lang").collect()}
    discard(counts)
    return model


def scores_of(scorer: Scorer, texts) -> np.ndarray:
    """Scores of an Arrow column of texts, in portions of about PORTION characters."""
    out, some, size = [], [], 0
    for text in texts:
        some.append(text.as_py() or "")
        size += len(some[-1])
        if size >= PORTION:
            out.append(scorer.score(some))
            some, size = [], 0
    if some:
        out.append(scorer.score(some))
    return np.concatenate(out) if out else np.empty(0)


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """Per row of ``docs``, by what ``train`` gave: doc_id, score, threshold (of its language, 0.5 where none is known), toxic.

    Null and empty texts have the score of a text without words. A null language has the threshold
    0.5. Repeated rows are scored each; extra columns are ignored; an empty table gives no rows.
    """
    shared, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        scorer = held_by_worker(token, lambda: Scorer(pickle.loads(shared.value)))
        cuts = scorer.model.thresholds
        for batch in batches:
            s = scores_of(scorer, batch.column(1))
            cut = np.array([cuts.get(x, 0.5) for x in batch.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array(cut), pa.array(s >= cut)], names=["doc_id", "score", "threshold", "toxic"]
            )

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return columns.mapInArrow(run, "doc_id long, score double, threshold double, toxic boolean")


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def reject(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs`` without the documents that the classifier holds toxic, all columns kept.

    Rows that share a doc_id go together if one of them is toxic; rows with a null doc_id stay. Null
    and empty texts are scored as texts without words. An empty table gives no rows.
    """
    return without(docs, score(docs, train(docs, labels, max_rows)).where("toxic and doc_id is not null"))
