import numpy as np

from codeloom.llm import embed_dedup, topk

SCHEMA = "vec_id long, embedding array<float>, label int, rep int"


def table(spark, x, more=()):
    rows = [(i, [float(v) for v in row], 0, 0) for i, row in enumerate(x)]
    return spark.createDataFrame(rows + list(more), SCHEMA)


def test_topk_against_all_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.3, (600, 16)).astype(np.float32)
    x[100:130] = x[50]  # ties
    odd = [(1000, None, 0, 0), (1050, [1.0, None] + [0.0] * 14, 0, 0), (1100, [float("nan")] * 16, 0, 0), (1150, [float("inf")] * 16, 0, 0), (1200, [], 0, 0), (None, [1.0] * 16, 0, 0)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(table(spark, x, odd)).collect()}
    q = np.floor(256 * x.astype(float)).astype(int)
    scores = q @ q.T
    want = {}
    for i in range(0, 600, 50):
        order = sorted((j for j in range(600) if j != i), key=lambda j: (-scores[i, j], j))[:5]
        want |= {(i, r): (j, scores[i, j]) for r, j in enumerate(order, 1)}
    assert got == want


def test_topk_blocks_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    x = np.eye(4, 5, dtype=np.float32)
    got = topk.search(table(spark, x), every=1).collect()
    assert len(got) == 12 and sorted((r.vec_id, r["rank"]) for r in got if r.query_id == 0) == [(1, 1), (2, 2), (3, 3)]
    assert topk.search(table(spark, x).limit(0)).collect() == []
    assert topk.search(table(spark, x[:1])).collect() == []


def test_topk_of_several_lengths(spark):
    rows = [(i, [float((i * 7 + k) % 5) for k in range(3 if i % 100 == 50 else 8)], 0, 0) for i in range(200)]
    got = topk.search(spark.createDataFrame(rows, SCHEMA)).collect()
    by_query = {q: sorted((r["rank"], r.vec_id) for r in got if r.query_id == q) for q in (0, 50, 100, 150)}
    assert [len(v) for v in by_query.values()] == [5, 1, 5, 1] and by_query[50] == [(1, 150)]


def test_topk_takes_all_rows_of_repeated_ids(spark):
    gen = np.random.default_rng(4)
    rows = [(int(i), gen.integers(-3, 4, 6).astype(float).tolist(), 0, 0) for i in gen.integers(0, 60, 300)]
    rows += [(50, [0.9, 0.1, 0.0, 0.0, 0.0, 0.0], 0, 0), (1, [0.9] * 6, 0, 0), (1, [0.5] * 6, 0, 0)]
    want = []
    for n, (i, v, *_) in enumerate(rows):
        if i % 50 == 0:
            scored = [(-sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(v, w)), j) for m, (j, w, *_) in enumerate(rows) if m != n]
            want += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:5], 1)]
    assert sorted(map(tuple, topk.search(spark.createDataFrame(rows, SCHEMA)).collect())) == sorted(want)


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 64))
    near = base[:20].repeat(6, 0) + rng.normal(0, 0.18, (120, 64))  # cosine about 0.97 to the base, 0.94 among them
    hot = base[0] + rng.normal(0, 0.2, (700, 64))
    x = np.concatenate([base, near, hot, base[:3], base[:3] * 2]).astype(np.float32)
    odd = [(9000, None, 0, 0), (9001, [0.0] * 64, 0, 0), (9002, [float("nan")] * 64, 0, 0), (9003, [1.0, None], 0, 0), (9004, [1.0, 2.0], 0, 0), (None, [1.0] * 64, 0, 0)]
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(table(spark, x, odd)).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    true, found = links.sum(), sum(r.n_links for r in got.values())
    assert found <= true and found >= 0.97 * true
    assert all(got[i].n_links <= n for i, n in enumerate(links.sum(1)))
    component = list(range(len(x)))
    changed = True
    while changed:
        changed = False
        for i in range(len(x)):
            low = min([component[i], *(component[j] for j in np.flatnonzero(links[i]))])
            changed, component[i] = changed or low != component[i], low
    assert np.mean([got[i].component_id == c for i, c in enumerate(component)]) > 0.99
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(9000, 9005))
    assert got[None].component_id is None and got[None].kept
    assert embed_dedup.near_duplicates(table(spark, x[:1]).limit(0)).collect() == []


def test_rotations_keep_lengths():
    plane = embed_dedup.CrossPolytope(48)
    x = np.random.default_rng(3).normal(size=(10, 48))
    y = plane.rotate(x, plane.signs[0, 0])
    ratio = np.linalg.norm(y, axis=1) / np.linalg.norm(x, axis=1)
    assert np.allclose(ratio, ratio[0]) and plane.codes(x).shape == (10, embed_dedup.TABLES, 1 + embed_dedup.VISITS)
