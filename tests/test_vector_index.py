"""The vector index against brute force: same rows and values, and how little is read."""

import numpy as np
import pytest

from codeloom.operators import vector_index, vectors

SCHEMA = "node_id string, vector array<float>"


def table(spark, m, prefix="v"):
    return spark.createDataFrame([(f"{prefix}{i:05d}", x.tolist()) for i, x in enumerate(np.asarray(m, np.float32))], SCHEMA).repartition(3)


def index_of(spark, tmp_path, rows, width, metric="l2"):
    index = vector_index.VectorIndex(spark, str(tmp_path / metric), width, metric)
    index.build(rows)
    return index


def same(index, rows, query, k):
    found, counts = index.search(query, k)
    got, want = found.collect(), vectors.knn(rows, query, k, index.metric).collect()
    assert [(r.node_id, r.score) for r in got] == [(r.node_id, r.score) for r in want]
    return counts


def test_clusters_are_ruled_out_by_their_radius(spark, tmp_path):
    gen = np.random.default_rng(1)
    m = np.repeat(gen.normal(size=(20, 16)) * 10, 60, 0) + gen.normal(size=(1200, 16)) * 0.3
    rows = table(spark, m)
    index = index_of(spark, tmp_path, rows, 16)
    for i in (0, 700):
        counts = same(index, rows, (m[i] + 0.01).tolist(), 10)
        assert counts.rows == 1200 and counts.coded < 300 and counts.opened < counts.cells / 2 and counts.compared < 40


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_without_clusters_codes_leave_few_vectors(spark, tmp_path, metric):
    m = np.random.default_rng(2).normal(size=(800, 64))
    m[5:9] = m[4]  # ties go by key
    rows = table(spark, m)
    index = index_of(spark, tmp_path, rows, 64, metric)
    for i, k in ((4, 3), (77, 20)):
        counts = same(index, rows, m[i].tolist(), k)
        assert counts.compared < 800 / 4


def test_few_rows_odd_rows_and_odd_queries(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [-1.0, 0.0]), ("d", [1.0, 0.0, 0.0]), ("e", None), ("f", [float("nan"), 1.0]), ("g", [0.0, 0.0]), ("h", [None, 1.0])], SCHEMA)
    good = rows.where("node_id in ('a', 'b', 'c', 'g')")
    for metric in ("l2", "cosine"):
        index = index_of(spark, tmp_path, rows, 2, metric)
        same(index, good, [1.0, 0.0], 9)
        same(index, good, [0.0, 0.0], 2)
        assert index.search([1.0], 3)[0].collect() == [] == index.search([1.0, 0.0], 0)[0].collect()
    empty = vector_index.VectorIndex(spark, str(tmp_path / "none"), 2)
    empty.build(rows.limit(0))
    assert empty.search([1.0, 0.0], 3)[0].collect() == []
    with pytest.raises(ValueError):
        vector_index.VectorIndex(spark, "x", 2, "manhattan")


def test_upserts_replace_remove_and_widen_cells(spark, tmp_path):
    gen = np.random.default_rng(3)
    m = gen.normal(size=(300, 8))
    index = index_of(spark, tmp_path, table(spark, m), 8)
    base = index.rows.state()["layers"][0]["rows"]
    moved, far = gen.normal(size=(10, 8)), gen.normal(size=(5, 8)) + 40
    index.upsert(table(spark, moved), spark.createDataFrame([("v00020",), ("v00021",)], "node_id string"))
    index.upsert(table(spark, far, "far"))
    rows = table(spark, np.concatenate([moved, m[10:]])).where("node_id not in ('v00020', 'v00021')").unionByName(table(spark, far, "far"))
    for q in (moved[3], m[20], far[0], m[200]):
        assert same(index, rows, q.tolist(), 7).rows == 303
    assert index.rows.state()["layers"][0]["rows"] == base and len(index.rows.state()["layers"]) == 3
