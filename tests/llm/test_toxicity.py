import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import toxicity

DOCS, LABELS = "doc_id long, text string, lang string, toxic int, score int", "doc_id long, quality int, toxic int"


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(800)]
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["zorgle", "zorglish", "WRONGO", "zorglent"])
        rows.append((i, " ".join(text), rng.choice(["en", "fr"]), int(bad)))
    return rows


def test_held_out_accuracy_and_scores_by_text_alone(spark):
    rows = corpus(1600)
    docs = spark.createDataFrame([(i, t, g, 9, 9) for i, t, g, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows], LABELS)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, _, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(got[i].score >= 0.5) == bool(y) for i, y in held])
    assert right > 0.97
    odd = spark.createDataFrame([(1, rows[0][1], "xx", 0, 0), (2, rows[0][1], None, 0, 0), (3, None, "en", 0, 0), (4, "", "en", 0, 0), (4, "", "en", 0, 0), (5, "word " * 300_000 + "zorgle", "en", 0, 0)], DOCS)
    scored = sorted(toxicity.score(odd, model).collect(), key=lambda r: r.doc_id)
    assert scored[0].score == scored[1].score == got[0].score and scored[2].score == scored[3].score == scored[4].score
    assert scored[5].score >= 0.5 and all(0 <= r.score <= 1 for r in scored) and scored[1].threshold == 0.5
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and np.mean([r.doc_id % 4 == 0 for r in kept.collect()]) < 0.03


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", "en", 0, 0)], DOCS)
    model = toxicity.train(docs, spark.createDataFrame([], LABELS))
    assert toxicity.score(docs, model).first().score == 0.0
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_rejects_beside_clashing_names(spark):
    rows = corpus(400, seed=2)
    docs = spark.createDataFrame([(i, t, g, 1, "x", "y") for i, t, g, _ in rows] + [(None, "zorgle", "en", 1, "x", "y"), (9_999, None, None, 1, "x", "y")], "doc_id long, text string, lang string, toxic int, _bad string, _gone string")
    kept = toxicity.reject(docs, spark.createDataFrame([(i, 1, y) for i, _, _, y in rows], LABELS))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {None, 9_999}


def test_training_is_bounded(spark):
    rows = corpus(300, seed=3)
    docs, labels = spark.createDataFrame([(i, t, g, 0, 0) for i, t, g, _ in rows] * 2, DOCS), spark.createDataFrame([(i, 1, y) for i, _, _, y in rows], LABELS)
    few = toxicity.train(docs, labels, max_rows=40, max_chars=2_000)
    assert few == toxicity.train(docs.repartition(3), labels, max_rows=40, max_chars=2_000)


def test_every_labelled_row_is_fitted_or_calibrates(spark):
    """Small pieces cut nothing off: whichever row changes, the model does; words that few rows hold are learnt."""
    rows = [r for r in corpus(200, seed=4) if zlib.crc32(str(r[0]).encode()) % 5 > 1]
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows], LABELS)
    pieces = toxicity.labelled(spark.createDataFrame([(i, t, g, 0, 0) for i, t, g, _ in rows], DOCS), labels, 20)
    assert sorted(r.doc_id for r in pieces.collect()) == [i for i, *_ in rows] and pieces.rdd.getNumPartitions() == -(-len(rows) // 20)

    def model(changed=None):
        docs = spark.createDataFrame([(i, "wholly other words" if i == changed else t, g, 0, 0) for i, t, g, _ in rows], DOCS)
        return toxicity.train(docs, labels, max_rows=20, max_chars=2_000)

    first = model()
    assert all(model(rows[at][0]) != first for at in (3, len(rows) // 2, len(rows) - 4))
    many = corpus(1600, seed=5)
    docs = spark.createDataFrame([(i, t, g, 0, 0) for i, t, g, _ in many], DOCS)
    scored = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([(i, 1, y) for i, _, _, y in many], LABELS), max_rows=300))
    held = {i: y for i, _, _, y in many if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([(r.score >= 0.5) == bool(held[r.doc_id]) for r in scored.collect() if r.doc_id in held]) > 0.95


def test_cuts_in_spark(spark):
    """The best F1 over all rows, in the middle of the widest gap among equal ones."""
    counts = spark.createDataFrame([("a", 0.9, 2, 2), ("a", 0.6, 1, 1), ("a", 0.2, 5, 0), ("b", 0.5, 4, 1)], "lang string, score double, n long, hits long")
    got = {r.lang: (r.hits, r.n, round(r.cut, 9)) for r in toxicity.best_cuts(counts, "lang").collect()}
    assert got == {"a": (3, 8, 0.4), "b": (1, 4, 0.25)}


def test_texts_are_shuffled_once_and_only_those_with_a_label(spark):
    """However the labels' size makes Spark join: before, every text was shuffled to meet the labels and again to its piece."""
    rows = corpus(900, seed=6)
    docs = spark.createDataFrame([(i, t, g, 0, 0) for i, t, g, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows if i % 9 == 0], LABELS)
    asked = sorted(i for i, *_ in rows if i % 9 == 0 and zlib.crc32(str(i).encode()) % 5 > 0)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        for threshold in ("-1", before):
            spark.conf.set(name, threshold)
            got = toxicity.labelled(docs, labels, 30)
            mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
            steps = [x.split("Arguments")[0] for x in got._jdf.queryExecution().explainString(mode).split("\n\n") if x.startswith("(")]
            assert sum(" Exchange\n" in x and "text#" in x for x in steps) == 1
            assert sorted(r.doc_id for r in got.collect()) == asked and got.rdd.getNumPartitions() == -(-len(asked) // 30)
    finally:
        spark.conf.set(name, before)


def test_likely_keeps_every_id_and_few_others(spark, monkeypatch):
    """Any id, negative and extreme ones too; beyond the bound of the table more rows pass, and none goes."""
    ids = spark.createDataFrame([(i,) for i in [*range(0, 20_000, 10), -5, -(1 << 63), (1 << 63) - 1]], "doc_id long")
    texts = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit("en").alias("lang")).unionByName(ids.where("doc_id < 0 or doc_id > 20000").selectExpr("doc_id", "'b' as text", "null as lang"))
    asked = {r.doc_id for r in ids.collect()}
    for bound, most in ((toxicity.MAX_MASKS, 0.12), (100, 0.5)):
        monkeypatch.setattr(toxicity, "MAX_MASKS", bound)
        got = toxicity.likely(texts, ids, len(asked))
        kept = [r.doc_id for r in got.collect()]
        assert got.columns == texts.columns and len(kept) == len(set(kept)) and asked <= set(kept)
        assert len(kept) - len(asked) < most * 20_000
    assert toxicity.likely(texts, ids.limit(0), 0).count() == 0
