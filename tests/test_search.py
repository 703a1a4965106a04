"""Full text against SQLite's own ranking, vectors against plain arithmetic, and query expansion."""

import hashlib
import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import fts, hybrid, vectors
from codeloom.sources import files


def test_bm25_against_sqlite(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    rows = [(str(i), " ".join(rng.choices(words, k=rng.randrange(1, 5))), " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(150)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, name, body, tokenize=\"unicode61 tokenchars '_'\")")
    db.executemany("insert into t values (?, ?, ?)", rows)
    terms = ["w1", "w7", "w33", "none"]
    want = dict(db.execute("select id, -bm25(t, 0, 10.0, 1.0) from t where t match ?", (" OR ".join(terms),)).fetchall())
    docs = spark.createDataFrame(rows, "node_id string, f_name string, f_body string").withColumn("kind", F.lit("file"))
    index = fts.postings(docs, ("name", "body"))
    got = {r.node_id: r.bm25 for r in fts.bm25(index, fts.doc_stats(index), terms, {"name": 10, "body": 1}, n_docs=len(rows)).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_hash_embedding_against_plain_code(spark):
    texts = {"a": "createInvoice for the billing_user", "b": "", "c": "the and for", "d": "HTTPServer x yz"}
    docs = spark.createDataFrame(list(texts.items()), "node_id string, text string")
    got = {r.node_id: r.vector for r in vectors.embed(docs, dimensions=32).collect()}
    for key, tokens in {"a": ["create", "invoice", "billing", "user"], "b": [], "c": [], "d": ["httpserver", "yz"]}.items():
        v = [0.0] * 32
        for t in tokens:
            p = f"^{t}$"
            for f in [f"t:{t}", *(f"3:{p[i:i + 3]}" for i in range(len(p) - 2)), *(f"4:{p[i:i + 4]}" for i in range(len(p) - 3))]:
                d = hashlib.blake2b(f.encode(), digest_size=8, key=vectors.MODEL.encode()[:16]).digest()
                v[int.from_bytes(d[:4], "little") % 32] += 1 if d[4] & 1 else -1
        norm = math.sqrt(sum(x * x for x in v)) or 1
        assert all(math.isclose(x / norm, y, abs_tol=1e-6) for x, y in zip(v, got[key]))


def test_nearest_by_cosine_and_distance(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [-1.0, 0.0]), ("d", [1.0, 0.0, 0.0])]
    e = spark.createDataFrame(rows, "node_id string, vector array<float>")
    assert [r.node_id for r in vectors.knn(e, [1.0, 0.0], 5, "cosine").collect()] == ["a", "b"]
    got = vectors.knn(e, [1.0, 0.0], 2).collect()
    assert [(r.node_id, round(r.score, 4)) for r in got] == [("a", 1.0), ("b", round(1 / (1 + math.sqrt(0.8)), 4))]


def test_rank_fusion_and_grouping(spark):
    rows = spark.createDataFrame([("a", "bm25", 1), ("b", "bm25", 2), ("b", "local-hash", 1)], "id string, source string, rank int")
    got = {r.id: (r.score, r.score_source) for r in hybrid.rrf(rows).collect()}
    assert got == {"b": (1.0, "hybrid"), "a": (round((1 / 61) / (1 / 61 + 1 / 62), 4), "bm25")}
    items = [(f"s{i}", "symbol", f"n{i}", "p.py", i, 1.0, i) for i in range(1, 8)] + [("f", "file", "q.py", "q.py", None, 0.5, 9)]
    found = spark.createDataFrame(items, "id string, kind string, name string, path string, line int, score double, place int")
    out = hybrid.group_by_file(found, 10).collect()
    assert [r.id for r in out] == ["s1", "s6", "s7", "f"] and [s.id for s in out[0].co_located_symbols] == ["s2", "s3", "s4", "s5"] and out[1].co_located_total == 6
    assert [r.id for r in hybrid.group_by_file(found, 10, collapse_all=True).collect()] == ["s1", "f"]


def test_tokenizers(spark):
    one = spark.createDataFrame([("getHTTPUser_name-for/file.x1 b",)], "t string")
    c = F.col("t")
    got = one.select(text.identifier_tokens(c), text.term_tokens(c), text.vector_tokens(c), text.name_terms(c)).first()
    assert list(got[0]) == ["get", "httpuser", "name", "for", "file", "x1"] and list(got[1]) == ["get", "httpuser", "name", "file"]
    assert list(got[2]) == ["get", "httpuser", "name", "file", "x1"] and list(got[3]) == ["get", "httpuser", "name"]


def test_expansion_meets_other_forms():
    assert {"create", "creation", "add", "invoice", "invoices"} <= set(text.expand_query("creating createInvoice"))
    assert text.expand_query("the and") == [] and text.reference_terms("Invoice.created_at the") == ["invoice", "created", "at"]


@pytest.mark.parametrize("pattern, path, hit", [("src/*.py", "src/a/b.py", True), ("*.ts", "a.tsx", False), ("a?c", "abc", True), ("[!x]y", "ay", True), ("[!x]y", "xy", False), ("a.b", "axb", False), ("**/t", "p/q/t", True)])
def test_globs(spark, pattern, path, hit):
    assert spark.createDataFrame([(path,)], "p string").where(files.matches_glob(F.col("p"), pattern)).count() == int(hit)


def test_like_has_live_wildcards_and_folds_ascii_only(spark):
    d = spark.createDataFrame([("aXb",), ("É",), ("a\\b",)], "s string")
    assert [d.where(fts.contains(F.col("s"), q)).count() for q in ("A_B", "é", "É", "\\", "%")] == [2, 0, 1, 1, 3]
