"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star edges.

* One pass hashes each document's whole shingle set into ``bands * rows`` bins (one permutation: a
  shingle's high bits choose its bin, its rank within the bin is its value) and fills empty bins by
  the optimal densification (an empty bin takes the filled one that comes first in an order of all
  bins of its own, so short texts' bins agree as independently as long ones').
* Documents with equal sets collapse to one representative through a digest of the set.
* In each bucket every member is paired with the bucket's hub only, so a bucket of m members gives
  m - 1 candidate edges: first with the hub that comes first in all buckets, then, for members that
  are in another component than the hub by then, with a hub that each bucket draws for itself.
* In a bucket that still holds several components, members outside the largest one are compared with
  all others in blocks of bounded size: an upper bound of the common shingles from bitmaps first, which
  rules out no pair that is similar enough, then the full sets. Pairs never become rows, and a pair
  is compared in the first bucket that it shares.
* Candidate edges are confirmed on the full sets, made anew from the whole texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import connected_components, discard, mix64, rough_components, shingle_set, stage, without

#: 32 bands of 6 rows: a pair at similarity 0.8 shares a bucket with probability 0.99994.
BANDS, ROWS = 32, 6
#: Bits of a set's bitmap: each bit that only one of two sets has is a shingle of its own at least.
BITMAP_BITS = 1_024


class Signer:
    """Signature bands of shingle sets; the probing orders are a table of fixed size."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.orders = mix64(np.arange(self.bins * self.bins, dtype=np.uint64) + np.uint64(0xC0DE)).reshape(self.bins, self.bins)
        self.weights = mix64(np.arange(1, self.bins + 1, dtype=np.uint64)).reshape(bands, rows) | np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Densified bins of a non-empty set."""
        h = mix64(shingles + np.uint64(0x5EED))
        bin_of = (h >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)
        sig = np.full(self.bins, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(sig, bin_of.astype(np.int64), (h & np.uint64(0xFFFFFFFF)) << np.uint64(16) | bin_of)
        full = sig != np.iinfo(np.uint64).max
        if not full.all():
            empty, there = np.flatnonzero(~full), np.flatnonzero(full)
            sig[empty] = sig[there[self.orders[np.ix_(empty, there)].argmin(1)]]
        return sig

    def band_keys(self, sig: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = mix64(sig.reshape(self.bands, self.rows)) * self.weights
            return mix64(mixed.sum(axis=1, dtype=np.uint64)).view(np.int64)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bits that the shingles of a set hit, in 64-bit words."""
    bits = np.zeros(BITMAP_BITS, np.uint8)
    bits[(mix64(shingles) % np.uint64(BITMAP_BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def most_common(n_a: int, a: np.ndarray, n_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bounds of the shingles that a set of ``n_a`` with bitmap ``a`` has in common with each of ``b``."""
    return np.minimum(n_a - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), n_b - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))


def signatures(docs: DataFrame, words: int = 2, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): n_shingles, digest of the set, band keys, bitmap.

    A row without shingles has a digest of its own (its id), so it equals no other document.
    """

    def run(batches):
        signer = Signer(bands, rows)
        for batch in batches:
            ids, n, digests, keys, bitmaps = batch.column(0), [], [], [], []
            for i, text in enumerate(batch.column(1)):
                s = shingle_set(text.as_py(), words)
                n.append(len(s))
                if len(s):
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keys.append(signer.band_keys(signer.signature(s)))
                    bitmaps.append(bitmap(s).view(np.int64))
                else:
                    digests.append(b"-" + str(ids[i].as_py()).encode())
                    keys.append(np.empty(0, np.int64))
                    bitmaps.append(None)
            sizes = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)), pa.array(bitmaps, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "bands", "bitmap"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, bands array<long>, bitmap array<long>"
    )


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of ``pairs`` (hub, doc), those with 100 * intersection >= percent * union of the full sets.

    ``texts`` has (id, text). The hub's set is kept while consecutive rows name the same hub, which
    the join's order gives.
    """
    rows = (
        pairs.join(texts.select(F.col("id").alias("doc"), F.col("text").alias("doc_text")), "doc")
        .join(texts.select(F.col("id").alias("hub"), F.col("text").alias("hub_text")), "hub")
        .select("hub", "doc", "hub_text", "doc_text")
    )

    def run(batches):
        last, kept = None, None
        for batch in batches:
            hubs, docs_, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            hub_texts, doc_texts = batch.column(2), batch.column(3)
            for i, hub in enumerate(hubs):
                hub_text = hub_texts[i].as_py()
                if (hub, hub_text) != last:
                    last, kept = (hub, hub_text), shingle_set(hub_text, words)
                mine = shingle_set(doc_texts[i].as_py(), words)
                both = len(kept) + len(mine)
                common = both - len(np.union1d(kept, mine))
                keep.append(100 * common >= percent * (both - common) and common > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hubs, pa.int64()), pa.array(docs_, pa.int64()), pa.array(keep, pa.bool_())], names=["hub", "doc", "linked"]
            )

    return rows.mapInArrow(run, "hub long, doc long, linked boolean").where("linked").select(F.col("hub").alias("u"), F.col("doc").alias("v")).distinct()


#: Shingles of a bucket's members that one task compares at a time.
BLOCK_SHINGLES = 2_000_000


def compare_rest(open_: DataFrame, signed: DataFrame, texts: DataFrame, words: int, percent: int, bands: int) -> DataFrame:
    """Links (u, v) between members of a bucket that are in different components: ``open_`` has key, rep, class."""
    sizes = open_.groupBy("key", "class").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "class")).alias("top")).select("key", F.col("top.class").alias("top"))
    members = open_.join(signed.select(F.col("doc_id").alias("rep"), "n_shingles"), "rep").join(largest, "key").withColumn("few", F.col("class") != F.col("top"))
    blocks = F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int")
    counts = members.groupBy("key").agg(blocks.alias("blocks"))
    # every block of the few meets every block of all members; a row's block is drawn by its hash
    placed = members.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    sent = placed.select("key", "rep", "class", "few", "block", F.explode(every).alias("other"))
    sides = F.array(F.struct(F.col("block").alias("i"), F.col("other").alias("j"), F.lit(True).alias("left")), F.struct(F.col("other").alias("i"), F.col("block").alias("j"), F.lit(False).alias("left")))
    sent = sent.select("key", "rep", "class", "few", F.explode(sides).alias("p")).where("few or not p.left").select("key", "rep", "class", "p.i", "p.j", "p.left")
    full = signed.select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "bitmap").join(texts.withColumnRenamed("id", "rep"), "rep")
    keys = ["key", "i", "j"]
    groups = sent.join(full, "rep").repartition(*keys).sortWithinPartitions(*keys, "rep", "left")

    def links_of(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group.left], group[~group.left]
        a, b = (np.stack(x.bitmap.to_numpy()).view(np.uint64) if len(x) else np.empty((0, BITMAP_BITS // 64), np.uint64) for x in (left, right))
        n_a, n_b = left.n_shingles.to_numpy(), right.n_shingles.to_numpy()
        bands_a, bands_b = (np.stack(x.bands.to_numpy()) if len(x) else np.empty((0, bands), np.int64) for x in (left, right))
        class_a, class_b, ids_a, ids_b = left["class"].to_numpy(), right["class"].to_numpy(), left.rep.to_numpy(), right.rep.to_numpy()
        few_b = np.isin(ids_b, ids_a)
        key, sets, out = group.key.iloc[0], {}, []
        for f in range(len(left)):
            near = np.flatnonzero((class_b != class_a[f]) & ~(few_b & (ids_b < ids_a[f])))
            # of n_a and n_b shingles so many must be common at the least
            near = near[(100 + percent) * most_common(n_a[f], a[f], n_b[near], b[near]) >= percent * (n_a[f] + n_b[near])]
            shared = bands_a[f] == bands_b[near]
            near = near[(shared.any(1)) & (bands_a[f][shared.argmax(1)] == key)]
            if not len(near):
                continue
            mine = shingle_set(left.text.iloc[f], words)
            for i in near.tolist():
                if i not in sets:
                    sets[i] = shingle_set(right.text.iloc[i], words)
            size = np.array([len(sets[i]) for i in near.tolist()])
            flat = np.concatenate([sets[i] for i in near.tolist()])
            at = np.minimum(np.searchsorted(mine, flat), max(len(mine) - 1, 0))
            common = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(size) - size)
            linked = near[100 * common >= percent * (len(mine) + size - common)]
            out += [(ids_a[f], ids_b[i]) for i in linked.tolist()]
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
            whole = int(last.argmax())  # rows of the last group may go on in the next batch
            held = pdf.iloc[whole:]
            for _, group in pdf.iloc[:whole].groupby(keys, sort=False):
                yield links_of(group)
        if held is not None and len(held):
            yield links_of(held)

    return groups.mapInPandas(run, "u long, v long").distinct()


def _open_buckets(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """``buckets`` (key, rep) with ``class``, the component; only buckets that hold several."""
    marked = buckets.join(classes, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("class"))
    several = marked.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("key")
    return marked.join(several, "key")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null or empty texts have no shingles and link with nothing. Of rows that share a doc_id each is
    classed by its own text. A null doc_id links with nothing: component_id is null and the row is
    kept. Extra columns of ``docs`` are ignored; an empty table gives no rows.
    """
    signed = stage(signatures(docs, words, bands, rows), "minhash")
    alike = stage(signed.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "minhash-reps")
    reps = signed.join(alike.withColumnRenamed("digest", "_d"), (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("_d")))
    keys = reps.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").drop("last")
    buckets = stage(keys.join(shared, "key").select("key", "rep", "hub").distinct(), "minhash-buckets")
    wanted = buckets.select(F.col("rep").alias("id")).distinct()
    texts = stage(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(wanted, "id", "left_semi"), "minhash-texts")

    # a star around the first of each bucket: one order for all, so a group has few hubs
    stars = buckets.where("rep <> hub").select("hub", F.col("rep").alias("doc")).distinct()
    links = stage(confirm(stars, texts, words, percent), "minhash-links")

    # a star around a hub of the bucket's own, for members that are not in its component yet
    now = stage(_open_buckets(buckets.select("key", "rep"), rough_components(links)), "minhash-open")
    drawn = now.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "rep").alias("order"), "rep", "class")).alias("h"))
    again = now.join(drawn, "key").where("class <> h.class").select(F.col("h.rep").alias("hub"), F.col("rep").alias("doc")).distinct()
    more = stage(links.unionByName(confirm(again, texts, words, percent)), "minhash-links")
    discard(links, buckets)

    # members outside their bucket's largest component meet the other components' members
    left = stage(_open_buckets(now.select("key", "rep"), rough_components(more)), "minhash-open")
    rest = compare_rest(left, reps.select("doc_id", "n_shingles", "bands", "bitmap"), texts, words, percent, bands)
    links = stage(more.unionByName(rest), "minhash-links")
    components = connected_components(links)
    discard(now, left, more, links, texts)
    result = signed.select("doc_id", "n_shingles", "digest").join(alike, "digest", "left")
    result = result.join(components.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return result.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are near copies of one with a smaller doc_id, all columns kept.

    Rows that share a doc_id go together; rows with a null doc_id, null or empty texts stay. An empty
    table gives no rows.
    """
    return without(docs, near_duplicates(docs, words, percent).where("not kept"))
