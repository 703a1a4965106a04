import random

import pytest
from pyspark.sql import functions as F

from codeloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, slot string, weight int"


def plain_schedule(weights):
    total, done, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for t in range(total):
        ready = [(-(-(done[k] + 1) * total // w), done[k] * total // w, k) for k, w in sorted(weights.items()) if done[k] * total // w <= t]
        best = min(ready)[2]
        out.append((best, done[best], t))
        done[best] += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 2, "c": 2}, {"big": 50, **{f"s{i:02}": 1 for i in range(50)}}, {"a": 7, "b": 11, "c": 13, "d": 29}])
def test_one_period_deviates_by_less_than_a_block(spark, weights):
    sources = spark.createDataFrame(list(weights.items()), "key string, weight long")
    got = sorted((r.slot, r.key, r.seq) for r in mixing.schedule(sources).collect())
    assert [(k, s, t) for t, k, s in got] == plain_schedule(weights)
    total, ran = sum(weights.values()), dict.fromkeys(weights, 0)
    for t, k, _ in got:
        ran[k] += 1
        assert all(abs(ran[x] * total - w * (t + 1)) < total for x, w in weights.items())


def test_rows_keep_their_columns_and_places(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(0, 200), rng.choice(["a", "a", "a", "b", None, ""]), "clash", 5) for i in range(400)]
    rows += [rows[0], (None, None, "a", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs.drop("slot"), {"a": 3, "b": 2}, block_chars=500).collect()
    assert len(got) == len(rows)
    for source in ("a", "b", None, ""):
        mine = sorted((r for r in got if r.source == source), key=lambda r: r.place)
        total = sum(len(r.text or "") for r in mine)
        assert {r.place for r in mine} <= set(range(total + 1)) and all(r.block == r.place // 500 for r in mine)
        ends = [0]
        for r in mine:
            assert r.place <= max(ends)
            ends.append(r.place + len(r.text or ""))
        slots = {r.block: r.slot for r in mine}
        assert len(set(slots.values())) == len(slots) and [slots[b] for b in sorted(slots)] == sorted(slots.values())
    ordered = mixing.mixture(docs, {"a": 3, "b": 2}, block_chars=500)
    assert ordered.columns == docs.columns and sorted(map(str, ordered.collect())) == sorted(map(str, docs.collect()))


def test_empty_table_and_bad_weights(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(docs.drop("slot"), {"a": 1}).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0})


@pytest.mark.parametrize("weights", [{"a": 5000, "b": 1, "c": 4999}, {f"s{i:02}": 1 + i % 7 for i in range(40)}])
def test_segments_give_the_schedule_of_one_row(spark, weights, monkeypatch):
    monkeypatch.setattr(mixing, "SEGMENT", 3000 if "a" in weights else 37)
    sources = spark.createDataFrame(list(weights.items()), "key string, weight long")
    got = sorted((r.slot, r.key, r.seq) for r in mixing.schedule(sources).collect())
    if "a" not in weights:
        assert [(k, s, t) for t, k, s in got] == plain_schedule(weights)
    total = sum(weights.values())
    assert [t for t, _, _ in got] == list(range(total))
    assert all(s * total // weights[k] <= t < -(-(s + 1) * total // weights[k]) for t, k, s in got)  # released, and within its deadline


def test_ten_thousand_sources(spark):
    docs = spark.range(20_000).select("id", F.concat(F.lit("s"), F.col("id") % 10_000).alias("source")).withColumn("text", F.lit("x" * 30)).withColumnRenamed("id", "doc_id")
    weights = {f"s{i}": 1 + i % 4 for i in range(9_000)}
    got = mixing.mix(docs, weights, block_chars=20)
    assert got.count() == 20_000 and got.where("source = 's3'").agg(F.max("slot")).first()[0] < sum(weights.values()) + 1_000
    assert got.groupBy("slot").agg(F.countDistinct("source").alias("n")).where("n > 1").isEmpty()


@pytest.mark.parametrize("factor,more", [(100_000, 0), (1_000_000, 1), (1, 0)])
def test_large_weights_walk_no_further_than_the_blocks(spark, factor, more, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 40, "abc"[i % 3], "", 0) for i in range(90)], SCHEMA).drop("slot")
    walked, plain = [], mixing._segment
    monkeypatch.setattr(mixing, "_segment", lambda begin, slots: walked.append(slots) or plain(begin, slots))
    got = {r.doc_id: (r.block, r.slot) for r in mixing.mix(docs, {"a": factor + more, "b": 2 * factor, "c": 3 * factor}, block_chars=100).collect()}
    assert sum(walked) <= 80  # 13 blocks of a source, each six slots wide at most; 6 million in the period
    total, slots = 6 * factor + more, {}
    for i, (block, slot) in got.items():
        w = factor + more if i % 3 == 0 else (i % 3 + 1) * factor
        assert block * total // w <= slot < -(-(block + 1) * total // w)
        assert slots.setdefault(slot, (i % 3, block)) == (i % 3, block)
    if not more:
        want = {(k, s): t for k, s, t in plain_schedule({"a": 60, "b": 120, "c": 180})}
        assert all(want["abc"[i % 3], block] == slot for i, (block, slot) in got.items())


def test_many_different_weights(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("x" * 30).alias("text"), F.concat(F.lit("s"), F.col("id") % 300).alias("source"))
    got = mixing.mix(docs, {f"s{i}": 1_000 + i for i in range(300)}, block_chars=40)
    assert got.count() == 600 and got.groupBy("slot").agg(F.countDistinct("source").alias("n")).where("n > 1").isEmpty()
