"""Watching: returns to earlier content, removals, and what they do to the graph."""

import pytest

from codeloom.plans.engine import Engine
from codeloom.sources import catalog
from codeloom.streaming import watch

SCHEMA = "path string, content string, at long"


@pytest.fixture
def landing(spark, tmp_path):
    class Landing:
        seen, turn = [], 0

        def put(self, rows):
            spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(str(tmp_path / "in" / str(self.turn)))
            self.turn += 1

        def run(self, merge=None):
            def keep(batch, n):
                self.seen.extend((r.path, r.content, r.gone) for r in batch.collect())

            stream = watch.file_stream(spark, str(tmp_path / "in" / "*"), schema=SCHEMA)
            watch.watch(watch.changes(stream, "at"), merge or keep, str(tmp_path / "cp")).awaitTermination()
            out, self.seen = sorted(self.seen, key=str), []
            return out

    return Landing()


def test_a_return_to_earlier_content_is_a_change(landing):
    landing.put([("a.py", "A", 1), ("b.py", "x", 1)])
    assert landing.run() == [("a.py", "A", False), ("b.py", "x", False)]
    landing.put([("a.py", "B", 2), ("b.py", "x", 2)])
    assert landing.run() == [("a.py", "B", False)]
    landing.put([("a.py", "A", 3), ("b.py", None, 3), ("c.py", None, 3)])
    assert landing.run() == [("a.py", "A", False), ("b.py", None, True)]
    landing.put([("b.py", None, 4), ("b.py", "x", 5), ("a.py", "C", 5), ("a.py", "D", 4)])
    assert landing.run() == [("a.py", "C", False), ("a.py", "D", False), ("b.py", "x", False)]


def test_the_graph_follows(spark, landing, tmp_path, monkeypatch):
    monkeypatch.setenv(catalog.HOME_ENV, str(tmp_path / "home"))
    engine = Engine(spark, catalog.Config(repo=str(tmp_path), embed={"auto": False}))
    landing.put([("a.py", "from b import two\n\ndef one():\n    two()\n", 1), ("b.py", "def two():\n    return three()\n\ndef three():\n    return 3\n", 1)])
    landing.run(engine.follow)
    assert {"symbol:a.py:one", "symbol:b.py:two", "symbol:b.py:three", "file:a.py"} <= {r.id for r in engine.nodes.collect()}
    assert [c["name"] for c in engine.callers("three")["callers"]] == ["two"]
    landing.put([("b.py", "def two():\n    return 2\n", 2)])
    landing.run(engine.follow)
    assert "symbol:b.py:three" not in {r.id for r in engine.nodes.collect()} and not engine.symbols("three") and engine.symbols("two")
    assert ("symbol:a.py:one", "symbol:b.py:two", "calls") in {(r.src, r.dst, r.kind) for r in engine.edges.collect()}
    landing.put([("b.py", None, 3)])
    landing.run(engine.follow)
    assert {r.path for r in engine.nodes.where("path is not null").collect()} == {"a.py"} and not engine.symbols("two")
    assert not [r for r in engine.edges.collect() if "b.py" in r.src + r.dst]
