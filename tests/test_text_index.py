"""The text index against full scores: block bounds, changes against a rebuild, kept counts."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.operators import fts, text_index

WORDS = [f"word{i}" for i in range(60)] + ["create", "created", "invoice"]


def nodes(spark, rows):
    from codeloom.schema import node_meta

    d = spark.createDataFrame(rows, "id string, kind string, name string, path string, body string, doc string")
    return d.select("id", "kind", "name", "path", F.lit(None).cast("int").alias("line"), node_meta(body_preview=F.col("body"), docstring=F.col("doc"), decorators=F.array(F.lit("get"))).alias("meta"))


def corpus(seed, ids):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=n))
    return [(f"n{i}", rng.choice(["symbol", "file"]), rng.choice(WORDS), f"a/{rng.choice(WORDS)}.py", say(int(2 ** rng.uniform(1, 6))), say(rng.randrange(0, 8))) for i in ids]


TERMS = ["word3", "word40", "create", "word55", "nothing"]


class Plain:
    """The full score in plain code, over postings that are collected once."""

    def __init__(self, documents):
        self.flat = [tuple(r) for r in fts.postings(documents).select("node_id", "kind", "field", "term", "tf").collect()]
        self.kind = {n: k for n, k, *_ in self.flat}
        self.length, self.df = Counter(), Counter(t for _, t in {(n, t) for n, _, _, t, _ in self.flat})
        for n, _, _, _, tf in self.flat:
            self.length[n] += tf

    def scores(self, terms, weights=None, kind=None):
        total, average = len(self.length), sum(self.length.values()) / len(self.length)
        heavy, out = Counter(), Counter()
        for n, _, f, t, tf in self.flat:
            if t in terms:
                heavy[n, t] += (weights or fts.WEIGHTS)[f] * tf
        for (n, t), w in heavy.items():
            if kind in (None, self.kind[n]):
                idf = math.log((total - self.df[t] + 0.5) / (self.df[t] + 0.5))
                out[n] += max(idf, 1e-6) * w * (fts.K1 + 1) / (w + fts.K1 * (1 - fts.B + fts.B * self.length[n] / average))
        return dict(out)


def close(got, want):
    return set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(text_index, "SPAN", 6)
        documents = fts.index_documents(nodes(spark, corpus(1, range(700))))
        index = text_index.TextIndex(spark, str(tmp_path_factory.mktemp("text")))
        index.build(documents)
        return index, Plain(documents)


def test_all_eight_fields_against_the_full_score(indexed):
    index, plain = indexed
    assert close({r.node_id: r.bm25 for r in index.bm25(TERMS).collect()}, plain.scores(TERMS))
    assert close({r.node_id: r.bm25 for r in index.bm25(TERMS, kind="symbol").collect()}, plain.scores(TERMS, kind="symbol"))
    assert index.totals() == (len(plain.length), sum(plain.length.values())) and dict(map(tuple, index.frequencies().collect())) == plain.df


def test_best_documents_skip_spans(indexed):
    (index, plain), skipped = indexed, []
    light = dict.fromkeys(fts.WEIGHTS, 1) | {"path": 0, "morph": 0}
    for terms, k, kind, weights in ((TERMS, 10, None, None), (["word55", "word0"], 5, None, light), (TERMS, 10, "file", light), (["create"], 10_000, None, None)):
        want = plain.scores(terms, weights, kind)
        best = sorted(want.values(), reverse=True)[:k]
        found, counts = index.top(terms, k, weights, kind)
        got = {r.node_id: r.bm25 for r in found.collect()}
        assert close(got, {n: s for n, s in want.items() if s >= best[-1] * (1 - 1e-12)})
        skipped += [1 - counts.scored / counts.spans] * (k <= 10)
    assert min(skipped) > 0.05 and max(skipped) > 0.2, skipped
    assert index.top([], 5)[0].collect() == [] == index.top(["nothing"], 5)[0].collect()


def test_changes_match_a_rebuild(spark, tmp_path):
    index = text_index.TextIndex(spark, str(tmp_path / "text"))
    rows = {r[0]: r for r in corpus(2, range(200))}
    make = lambda some: fts.index_documents(nodes(spark, list(some)))
    index.build(make(rows.values()))
    for turn in range(2):
        new = {r[0]: r for r in corpus(10 + turn, range(turn * 20, turn * 20 + 30))} | {f"x{turn}": (f"x{turn}", "symbol", "fresh", "p.py", "word3 fresh", "")}
        gone = [f"n{i}" for i in range(150 + turn * 5, 155 + turn * 5)]
        index.update(make(new.values()), spark.createDataFrame([(g,) for g in gone], "node_id string"))
        rows = {k: v for k, v in rows.items() if k not in gone} | new
    plain = Plain(make(rows.values()))
    want = plain.scores([*TERMS, "fresh"])
    assert close({r.node_id: r.bm25 for r in index.bm25([*TERMS, "fresh"]).collect()}, want)
    assert dict(map(tuple, index.frequencies().collect())) == plain.df and index.totals() == (len(plain.length), sum(plain.length.values()))
    found, _ = index.top([*TERMS, "fresh"], 7)
    assert close({r.node_id: r.bm25 for r in found.collect()}, {n: s for n, s in want.items() if s >= sorted(want.values(), reverse=True)[6] * (1 - 1e-12)})
    layers = index.postings.files()
    assert len(layers) == 3 and all(n <= 2 for n in layers[1:])
    index.postings.compact()  # a state that the documents' table doesn't name doesn't count
    assert close({r.node_id: r.bm25 for r in index.bm25([*TERMS, "fresh"]).collect()}, want)


def test_blocks_are_made_in_one_shuffle_of_the_tokens(spark, tmp_path):
    index = text_index.TextIndex(spark, str(tmp_path / "text"))
    rows, _ = index._rows(fts.index_documents(nodes(spark, corpus(3, range(50)))))
    plan = text_index._pack(index._spanned(rows, {8: 2}, 1_000))._jdf.queryExecution().executedPlan().toString()
    assert plan.partition("Initial Plan")[0].count("Exchange") == 1


def test_rows_that_share_a_node_count_together(spark, tmp_path):
    documents = fts.index_documents(nodes(spark, corpus(4, range(60)) + corpus(5, range(10))))
    index, plain = text_index.TextIndex(spark, str(tmp_path / "text")), Plain(documents.dropDuplicates(["node_id", "raw"]))
    index.build(documents)
    assert index.totals()[0] == 60 and index.frequencies().where("term = 'create'").first().df == plain.df["create"]
    assert {r.node_id for r in index.bm25(TERMS).collect()} == set(plain.scores(TERMS))


def test_one_reading_gives_the_full_score(spark):
    documents = fts.index_documents(nodes(spark, corpus(6, range(80))))
    plain = Plain(documents)
    assert close({r.node_id: r.bm25 for r in fts.bm25_once(documents, TERMS).collect()}, plain.scores(TERMS))
    assert fts.bm25_once(documents.limit(0), TERMS).collect() == []
