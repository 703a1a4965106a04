"""Hashed vectors against a plain sum over features; pieces that words share are hashed once."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from codeloom.operators import vectors


def plain(words, dimensions):
    sums = np.zeros(dimensions)
    for w in words:
        for f in vectors.HashedWords("m", dimensions).features(w):
            d = hashlib.blake2b(f.encode(), digest_size=8, key=b"m").digest()
            sums[int.from_bytes(d[:4], "little") % dimensions] += 1.0 if d[4] & 1 else -1.0
    norm = np.sqrt((sums * sums).sum())
    return sums / norm if norm else sums


def test_vectors_are_the_plain_sums_and_pieces_are_hashed_once():
    rng, made = random.Random(3), []
    texts = [["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(0, 40))] for _ in range(60)]
    words = vectors.HashedWords("m", 64)
    with pytest.MonkeyPatch.context() as patch:
        real = hashlib.blake2b
        patch.setattr(vectors.hashlib, "blake2b", lambda f, **k: made.append(f) or real(f, **k))
        got = np.concatenate([words.vectors(pa.array(texts[i : i + 20], pa.list_(pa.string()))) for i in (0, 20, 40)])
    assert np.array_equal(got, np.array([plain(t, 64) for t in texts]))
    assert len(made) == len(set(made)) and len(made) < sum(len(words.features(w)) for w in {w for t in texts for w in t})


def test_a_full_memory_is_emptied_without_a_change_of_results():
    texts = [[f"w{i}x{j}" for j in range(30)] for i in range(20)]
    few = vectors.HashedWords("m", 64)
    few.REMEMBERED, few.PIECES = 50, 20
    got = np.concatenate([few.vectors(pa.array([t], pa.list_(pa.string()))) for t in texts])
    assert np.array_equal(got, np.array([plain(t, 64) for t in texts]))


def test_tasks_of_a_worker_share_the_memory():
    assert vectors._held_words("m", 64) is vectors._held_words("m", 64)
