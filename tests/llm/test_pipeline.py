import random
import re
from hashlib import md5, sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_line_dedup import plain as plain_lines


def test_stages_run_in_order_and_keep_columns(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < docs.count() <= before
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == before
    assert len(corpus_pipeline.STAGES) == 5


def plain_order(rows, weights):
    """doc_ids in the order of the Pfair schedule over blocks of 65,536 characters, by hand."""
    total, done, slots = sum(weights.values()), dict.fromkeys(weights, 0), {}
    for t in range(20 * total):
        ready = [(-(-(done[k] + 1) * total // w), done[k] * total // w, "=" + k, k) for k, w in weights.items() if done[k] * total // w <= t]
        k = min(ready)[3]
        slots[k, done[k]] = t
        done[k] += 1
    out = []
    for source in weights:
        at = 0
        for i, text, _ in sorted((r for r in rows if r[2] == source), key=lambda r: (md5(str(r[0]).encode()).hexdigest()[:2], r[0])):
            out.append((slots[source, at // 65_536], at, i))
            at += len(text)
    return [i for _, _, i in sorted(out)]


def test_result_is_in_the_order_of_the_mixture(spark, tmp_path):
    rows = [(i, f"word{i} " * 2_000, f"src{i % 3}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = plain_order(rows, {f"src{i}": 1 + i for i in range(3)})
    assert len({i // 15 for i in want}) > 1 and want != sorted(want)
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    mixed.repartition(3).write.parquet(f"{tmp_path}/mixed")
    out = corpus_pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/mixed"), "")
    assert [r.doc_id for r in out.collect()] == want


def test_run_returns_the_places_of_the_mixture(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "slot", "place"]
    got = [(r.slot, r.place, r.doc_id) for r in out.collect()]
    assert got == sorted(got) and len({s for s, _, _ in got}) > 1


def test_passages_of_one_source_stand_once(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, "\n".join([passage, " ".join(f"d{i}w{k}" for k in range(80))]), "src0") for i in range(4)]
    docs = spark.createDataFrame([*rows, (9, rows[0][1], "src0")], "doc_id long, text string, source string")
    for stage in (corpus_pipeline.dedup_lines, corpus_pipeline.dedup_documents):
        docs = stage(spark, docs, "")
    got = {r.doc_id: r.text for r in docs.collect()}
    assert got == {i: t if i == 0 else t.split("\n")[1] for i, t, _ in rows}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def plain_near(rows):
    """Rows left when one of each group of near copies stays, all pairs compared."""
    sets, parent = {i: shingles(t) for i, t, _ in rows}, {i: i for i, _, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return [r for r in rows if root(r[0]) == r[0]]


def plain_passages(rows):
    """Lines of 50 words or more that stand in two documents, cut out of all but the first."""
    where = {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        for p, line in enumerate((t or "").split("\n")):
            if len(line.split()) >= 50:
                where.setdefault(line, []).append((i, p))
    gone = {x for places in where.values() if len({i for i, _ in places}) > 1 for x in places[1:]}
    return [(i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone), s) for i, t, s in rows]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with toxic words, boilerplate, copies, near copies and shared passages; a folder with them and labels."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(900)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, footer = some(60), "all rights are reserved by them"
    rows = []
    for i in range(500):
        text = [some(rng.randrange(20, 60)) for _ in range(3)]
        if i % 4 == 0:
            text = [f"{x} {rng.choice(('zorgle', 'WRONGO', 'zorglent'))} {rng.choice(words)}" for x in text]
        if i % 6 == 1:
            text.append(footer)
        if i % 50 == 3:
            text.insert(1, passage)
        rows.append((i, "\n".join(text), f"src{rng.choice([0, 0, 0, 1, 2, 3])}", "en"))
    for i in range(500, 560):
        j, source = rng.randrange(1, 400) | 1, f"src{i % 5}"
        copy = rows[j][1].split(" ")
        copy[len(copy) // 2] = "changed" if i % 2 else copy[len(copy) // 2]
        rows.append((i, " ".join(copy), source, "en"))
    rows += [(600, None, "src1", "en"), (601, "", "src1", None)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(500)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def taken(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=lambda r: r[0])


def test_each_stage_against_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        outs.append(docs := spark.read.parquet(f"{tmp_path}/{k}"))
    clean = taken(outs[0])
    ids = {i for i, _, _ in clean}
    assert len([i for i in range(0, 500, 4) if i in ids]) <= 6 and len([i for i in range(500) if i % 4 and i not in ids]) <= 8 and {600, 601} <= ids
    cut = taken(outs[1])
    assert [(i, t) for i, t, _ in cut] == [(i, t) for i, t, _, _ in sorted(plain_lines(clean), key=lambda r: r[0])]
    near = taken(outs[2])
    assert near == plain_passages(plain_near(cut)) and len(near) < len(cut) - 30
    assert taken(outs[3]) == near
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, _ in near}
    got = {r.doc_id: r for r in outs[4].collect()}
    assert {i: (r.n_tokens, r.ids_sha256) for i, r in got.items()} == {i: (len(x), sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in want.items()}
    assert all(got[i].decoded_sha256 == sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest() for i, x in want.items())
    result = corpus_pipeline.run(spark, small).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in result) == sorted((i, r.ids_sha256) for i, r in got.items())


def test_stages_of_an_empty_table_and_null_ids(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(None, "x", None, None, 1), (1003, None, "src1", "en", 2), (1003, "a b", "src1", "en", 3), (1004, "", None, None, 4), (1005, "word " * 200_000, "src0", "en", 5)], "doc_id long, text string, source string, lang string, slot int")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).collect() == []
        assert stage(spark, odd, small).count() == 5
