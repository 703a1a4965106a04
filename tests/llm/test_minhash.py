import random
import re

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import minhash
from codeloom.llm.common import shingle_set, word_hashes

SCHEMA = "doc_id long, text string, component_id string, rep int, key int"


def plain_set(text, words):
    w = [m.translate({i: i + 32 for i in range(65, 91)}) for m in re.findall("[^\x20\x09-\x0d]+", text or "")]
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def plain_components(rows, words, percent):
    sets = [(i, plain_set(t, words)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in rows}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 40, 200]))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 12)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(words).upper() if rng.random() < 0.2 else " ".join(words)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "é b É"), (n + 4, "é b É")]


def test_components_against_all_pairs(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    for words in (2, 5):
        got = {r.doc_id: r for r in minhash.near_duplicates(docs, words, 80).collect()}
        want = plain_components(rows, words, 80)
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
        assert all(got[i].n_shingles == len(plain_set(t, words)) for i, t in rows)


def test_empty_table_and_null_ids(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e f", "", 0, 0), (4, "a b c d e f", "", 0, 0), (4, "a b c d e f", "", 0, 0)], SCHEMA)
    got = minhash.near_duplicates(docs, 2).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (4, 4, True), (4, 4, True)]


def test_keep_one_of_each_keeps_columns_and_clean_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "", 0, 0), (2, "A b c d e f g", "", 0, 0), (3, "other words stand here now ok", "", 0, 0), (5, None, "", 0, 0)], SCHEMA)
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5]


def test_long_texts_hash_as_short_ones_do():
    text = " ".join(f"word{i % 977}" for i in range(300_000))
    h = word_hashes(text.encode())
    assert len(h) == 300_000 and len(np.unique(h)) == 977 and len(shingle_set(text)) == 977


def test_signatures_estimate_the_similarity():
    rng, signer = np.random.default_rng(2), minhash.Signer()
    for share in (0.5, 0.8, 0.9):
        off = []
        for _ in range(40):
            x = rng.integers(0, 2**63, 400).astype(np.uint64)
            n = int(400 * 2 * share / (1 + share))
            y = np.concatenate([x[:n], rng.integers(0, 2**63, 400 - n).astype(np.uint64)])
            true = n / (800 - n)
            off.append((signer.signature(x) == signer.signature(y)).mean() - true)
        assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_short_sets_share_a_band_and_pass_the_bound():
    rng, signer = np.random.default_rng(5), minhash.Signer()
    for small, large in ((4, 5), (5, 6), (8, 10), (9, 10)):
        missed = 0
        for _ in range(2_000):
            x = rng.integers(0, 2**63, large).astype(np.uint64)
            a, b = np.sort(x[:small]), np.sort(x)
            missed += not (signer.band_keys(signer.signature(a)) == signer.band_keys(signer.signature(b))).any()
            assert minhash.most_common(small, minhash.bitmap(a), np.array([large]), minhash.bitmap(b)[None])[0] >= small
        assert missed <= 2


def test_short_texts_of_one_bucket_are_compared_on_full_sets(spark):
    rng = random.Random(6)
    rows, want = [], set()
    for k in range(300):  # pairs of 4 to 10 shingles, both in one bucket of all
        n = rng.choice([4, 5, 8, 9])
        text = [f"w{k}x{i}" for i in range(n + 1)]
        more = [*text, f"w{k}y"] if n != 8 else [*text, f"w{k}y", f"w{k}z"]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(more))]
        want.add((2 * k, 2 * k + 1))
    texts = spark.createDataFrame(rows, "id long, text string")
    signed = minhash.signatures(texts.withColumnRenamed("id", "doc_id"), 2).drop("digest")
    shared = spark.createDataFrame([(r.doc_id, k) for r in signed.collect() for k in r.bands], "rep long, key long").withColumn("class", F.col("rep"))
    links = minhash.compare_rest(shared, signed, texts, 2, 80, minhash.BANDS)
    got = {(min(r.u, r.v), max(r.u, r.v)) for r in links.collect()}
    assert got <= want and len(want - got) <= 1


def test_keeps_one_of_each_beside_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, "a", "b"), (1, text, "a", "b"), (2, text + " more", "a", "b"), (2, "alone here", "a", "b"), (None, text, "a", "b"), (7, None, "a", "b"), (8, "", "a", "b"), (9, "other words", "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string, component_id string")
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "7", "8", "9", "None"]
    assert minhash.keep_one_of_each(docs.limit(0)).collect() == []
