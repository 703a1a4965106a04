"""Layered tables against plain dictionaries: changes, removals, buckets, compaction, conflicts."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.sources import layers, shared_files, staging

SCHEMA = "id string, n long"


def table(spark, tmp_path, **how):
    return layers.Layered(spark, str(tmp_path / "t"), ["id"], layers.hash_bucket("id", 16), **how)


def rows_of(t, **how):
    return sorted(map(tuple, t.read(**how).collect()))


def test_changes_against_a_dictionary(spark, tmp_path):
    rng, t = random.Random(1), table(spark, tmp_path, most_layers=3)
    want = {f"k{i}": i for i in range(200)}
    t.write(spark.createDataFrame(list(want.items()), SCHEMA))
    for turn in range(6):
        new = {f"k{rng.randrange(260)}": 1000 * turn + i for i in range(20)}
        gone = [f"k{rng.randrange(260)}" for _ in range(10)]
        new = {k: v for k, v in new.items() if k not in gone}
        keys = spark.createDataFrame([(k,) for k in [*new, *gone]], "id string")
        t.change(spark.createDataFrame(list(new.items()), SCHEMA), keys, turn=turn)
        want = {k: v for k, v in want.items() if k not in gone} | new
        assert rows_of(t) == sorted(want.items()) and t.meta("turn") == turn and len(t.state()["layers"]) <= 3
    some = layers.buckets_of(spark, ["k1", "k2"], 16)
    held = {r.id for r in t.read().where(layers.hash_bucket("id", 16).isin(some)).collect()}
    assert {k for k, _ in rows_of(t, buckets=some)} == held and 0 < len(held) < len(want) / 2
    assert rows_of(t, buckets=[]) == []


def test_a_small_change_writes_few_files_and_leaves_the_rest(spark, tmp_path):
    t = layers.Layered(spark, str(tmp_path / "t"), ["id"], layers.hash_bucket("id", 64))
    t.write(spark.range(20_000).select(F.col("id").cast("string"), F.col("id").alias("n")))
    base = t.state()["layers"][0]["rows"]
    before = {n: shared_files.fingerprint(spark, f"{base}/{n}") for n in shared_files.names(spark, base)}
    t.change(spark.range(0, 20_000, 100).select(F.col("id").cast("string"), F.lit(-1).cast("long").alias("n")))  # one in a hundred
    assert before == {n: shared_files.fingerprint(spark, f"{base}/{n}") for n in shared_files.names(spark, base)}
    first, change = t.files()
    assert first >= 64 and change <= 0.05 * first
    assert t.read().where("n = -1").count() == 200 and t.read().count() == 20_000


def test_only_the_buckets_that_are_asked_for_are_opened(spark, tmp_path):
    t = table(spark, tmp_path)
    t.write(spark.createDataFrame([(f"k{i}", i) for i in range(500)], SCHEMA))
    opened = t.read(buckets=[3, 5]).inputFiles()
    assert opened and all("/_bucket=3/" in f or "/_bucket=5/" in f for f in opened)


def test_older_manifests_go_and_a_second_writer_is_told(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    for i in range(7):
        t.write(spark.createDataFrame([("a", i)], SCHEMA))
    assert len(t._numbers()) == layers.KEPT and sum(n.startswith("rows-") for n in shared_files.names(spark, t.folder)) == layers.KEPT
    assert rows_of(t, number=t._numbers()[0]) == [("a", 7 - layers.KEPT)] and rows_of(t) == [("a", 6)]
    seen = t._numbers()[:-1]  # another writer has added the last one since
    monkeypatch.setattr(t, "_numbers", lambda: seen)
    with pytest.raises(layers.Conflict):
        t.write(spark.createDataFrame([("a", 9)], SCHEMA))


def test_packed_rows_are_replaced_one_by_one(spark, tmp_path):
    pack = lambda d: d.groupBy((F.col("n") % 3).alias("g")).agg(F.collect_list(F.struct("id", "n")).alias("all"))
    t = layers.Layered(spark, str(tmp_path / "p"), ["id"], F.col("g").cast("int"), pack, lambda d: d.select(F.explode("all").alias("x")).select("x.*"))
    t.write(spark.createDataFrame([(f"k{i}", i) for i in range(30)], SCHEMA))
    t.change(spark.createDataFrame([("k3", 100)], SCHEMA), spark.createDataFrame([("k3",), ("k4",)], "id string"))
    want = sorted([(f"k{i}", i) for i in range(30) if i not in (3, 4)] + [("k3", 100)])
    assert rows_of(t) == want and t.read(packed=True).count() == 4
    t.compact()
    assert rows_of(t) == want and t.read(packed=True).count() == 3


def test_a_stored_table_is_made_anew_when_its_source_is_rewritten(spark, tmp_path, monkeypatch):
    path, made = str(tmp_path / "source.parquet"), []

    def stored(key="of the source"):
        return staging.stored(spark, key, lambda: made.append(1) or spark.read.parquet(path), sources=[path]).count()

    spark.range(1).write.parquet(path)
    assert [stored(), stored(), len(made)] == [1, 1, 1]
    spark.range(2).write.mode("overwrite").parquet(path)
    assert [stored(), stored(), len(made)] == [2, 2, 2]
    monkeypatch.setattr(staging, "MOST_STORED", 2)
    kept = [stored(f"other {i}") for i in range(3)]
    assert kept == [2, 2, 2] and len(staging._STORED) == 2
