import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import spelling

SCHEMA = "doc_id long, text string, word int, n string"
LETTERS = "abcdefghijklmnopqrstuvwxyzßéè×÷É"


def plain_words(rows, every):
    counts = {}
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if every and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] = counts.get(word, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    """Exactly one letter inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows, every):
    words, out = plain_words(rows, every), {}
    for w, n in words.items():
        others = [v for v in words if near(v, w)]
        top = min(others, key=lambda v: (-words[v], v), default=None)
        form = top if top and words[top] >= 2 * n else None
        out[w] = (n, len(others), form, words[form] if form else None)
    for w in out:
        end = w
        while out[end][2]:
            end = out[end][2]
        out[w] += (end,)
    return out


def got(spark, rows, every=97):
    found = spelling.variants(spark.createDataFrame(rows, SCHEMA).repartition(3), every=every).collect()
    assert len({r.word for r in found}) == len(found)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found}


def corpus(seed, n_docs, every_word=1):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(LETTERS[:6]) for _ in range(rng.randrange(4, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa", "straße", "élève", "abababab"]
    rows = []
    for i in range(n_docs):
        words = []
        for _ in range(rng.randrange(0, 40)):
            w = rng.choice(stems[: rng.choice([3, 10, 46])])
            at, c = rng.randrange(len(w)), rng.choice(LETTERS)
            w = rng.choice([w, w, w, w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w.upper(), w.capitalize()])
            words.append(w)
        rows.append((i, rng.choice([" ", "-", "1", "\n", "中"]).join(words), 1, "n"))
    return rows


def test_equals_all_pairs(spark):
    for seed, every in ((1, 97), (2, 5), (3, 0)):
        rows = corpus(seed, 500)
        want = plain(rows, every)
        assert len(want) > 100 and sum(v[2] is not None for v in want.values()) > 50
        assert got(spark, rows, every) == want


def test_nulls_repeated_rows_and_empty_table(spark):
    rows = corpus(4, 60)
    rows += rows[:10] + [(None, rows[0][1], None, None), (None, None, None, None), (7, "", None, None), (8, None, 1, "")]
    assert got(spark, rows, 5) == plain(rows, 5)
    assert got(spark, []) == {} == got(spark, [(1, None, None, None), (2, "a b c", None, None)])


def test_a_chain_of_forms_ends_in_its_root(spark):
    text = " ".join(w for w, n in (("planets", 200), ("planet", 90), ("plane", 40), ("planer", 20), ("planar", 9), ("planarr", 4)) for _ in range(n))
    found = got(spark, [(1, text, 0, "")], 0)
    assert {v[4] for v in found.values()} == {"planets"}
    assert found["planarr"][2] == "planar" and found["planar"][1] == 2


def test_ties_go_to_the_first_word(spark):
    text = " ".join(["wordb"] * 8 + ["worda"] * 8 + ["wordz"] * 4 + ["wordé"] * 8)
    assert got(spark, [(1, text, 0, "")], 0)["wordz"] == (4, 3, "worda", 8, "worda")


def test_a_long_text_is_read_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 50)
    text = " ".join(random.Random(1).choice(["stand", "stands", "standing", "sta"]) for _ in range(500)) + "longrun" * 30
    assert "".join(spelling._blocks(text)) == text
    runs = [w for b in spelling._blocks(text) for w in spelling.RUN.findall(b)]
    assert runs == spelling.RUN.findall(text)


def test_strings_decide_where_keys_collide():
    rows = [("house", 5, -1), ("houses", 3, 5), ("mouse", 9, 2), ("moose", 4, 2), ("unlike", 7, 0)]  # one key for all
    found = sorted(spelling.near_in_group(rows))
    assert found == [("house", 1, 3, "houses"), ("houses", 1, 5, "house"), ("moose", 1, 9, "mouse"), ("mouse", 1, 4, "moose")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(LETTERS, min_size=1, max_size=12), min_size=1, max_size=20, unique=True))
def test_keys_are_equal_for_equal_strings(words):
    index, place, key = spelling.deletion_keys(words)
    seen = {}
    for i, p, k in zip(index.tolist(), place.tolist(), key.tolist()):
        left = words[i] if p < 0 else words[i][:p] + words[i][p + 1 :]
        assert seen.setdefault(left, k) == k
    assert len(set(seen.values())) == len(seen)
    assert len(key) == sum(map(len, words)) + len(words) and key.dtype == np.int64
