import hashlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from codeloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, decoded string"
ODD = [
    "", "a", "Hello's WE'LL it'd 'S", "ΑΣ ΣΑΣ Σ", "İstanbul ﬁ ½ ² Ⅷ ٣", "a\x1cb\x1db\x85c d e​f", "éÅ q̣̇", "<|startoftext|>abc<|endoftext|> x<|EndOfText|>",
    "x" * 5000, "ab" * 300 + " " + "é" * 400, "\U0001f600\U0001f468‍\U0001f469 日本語 한국어", "!!!###$$$ a_b-c 1234 'sx 'reel", "�\x00 \x7f", "Ω ǅ ẞ ß ŉ", "12ab34", "word. word, word! w|", "Σ.",
]


def test_ids_and_text_are_the_librarys(spark):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + ODD
    docs = spark.createDataFrame([(i, t, "clash", "") for i, t in enumerate(texts)] + [(10_000, None, "", "")], SCHEMA)
    got = {r.doc_id: r for r in bpe.encode(docs, PATH, lexicon_words=3000, with_ids=True).collect()}
    library = Tokenizer.from_file(PATH)
    for i, t in enumerate([*texts, *[""]]):
        r = got[i if i < len(texts) else 10_000]
        ids = library.encode(t, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.decoded, r.n_tokens) == (ids, text, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_the_automaton_is_minimal_and_exact(tmp_path):
    words = sorted({a + b + c for a in ("", "un", "re") for b in ("do", "make", "take") for c in ("", "s", "ing", "er")})
    entries = {w.encode(): [i, i + 1] for i, w in enumerate(words)}
    path = tmp_path / "lexicon.fsa"
    path.write_bytes(bpe.Lexicon.build(entries))
    lexicon = bpe.Lexicon(str(path))
    ranks = lexicon.ranks([*entries, b"", b"und", b"unmakess", b"zz"])
    assert ranks.tolist() == [*range(len(words)), -1, -1, -1, -1]
    for w, r in zip(entries, ranks):
        assert lexicon.ids[lexicon.start[r] : lexicon.start[r + 1]].tolist() == entries[w]
    futures = {frozenset(w[i:] for w in words if w.startswith(p)) for w in words for i in range(len(w) + 1) for p in [w[:i]]}
    assert len(lexicon.final) == len(futures)


def test_empty_lexicon(tmp_path):
    path = tmp_path / "lexicon.fsa"
    path.write_bytes(bpe.Lexicon.build({}))
    assert bpe.Lexicon(str(path)).ranks([b"a", b""]).tolist() == [-1, -1]


def test_merges_together_are_merges_singly():
    tokenizer = bpe.WordBpe(bpe.load_spec(PATH))
    words = ["a", "banana", "xyzzy" * 9, "é" * 30, "<|endoftext|>", "q" * 300, "the", "of", "日本語"]
    for word, ids in zip(words, tokenizer.merge_all(words)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.merge(word)
