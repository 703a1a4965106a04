"""The scan of a tree of files: what it lists, what it never lists, and the tree as a stream."""

import os

import pytest

from codeloom.sources import files, tree
from codeloom.streaming import watch

FILES = {
    "pkg/__init__.py": b"import a\n", "pkg/_hidden.py": b"x = 1\n", ".github/notes.md": b"# n\n", ".eslintrc.json": b"{}", "a b/c.py": b"y\xff = 2\n",
    "deep/1/2/3/4/z.ts": b"let z\n", "empty.py": b"", "big.py": b"x" * 90, "skip.txt": b"no", "node_modules/m/i.js": b"no", "pkg/venv/q.py": b"no",
    "gen/one/two.py": b"no", "gen_not/two.py": b"yes", "web/app.min.js": b"no", "build": b"a file of that name",
}
IGNORES = [*files.IGNORES, "gen/*", "*.min.js"]
WANTED = {p for p, b in FILES.items() if b != b"no" and p not in ("skip.txt", "build")}


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "tree"
    for path, content in FILES.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_bytes(content)
    os.symlink(base, base / "deep" / "loop")
    os.symlink(base / "pkg" / "_hidden.py", base / "deep" / "link.py")
    os.symlink(base / "nowhere.py", base / "deep" / "broken.py")
    return base


@pytest.mark.parametrize("folders", [1, 3, 256])
def test_ignored_folders_are_never_listed(root, monkeypatch, folders):
    monkeypatch.setattr(tree, "FOLDERS", folders)
    listed, plain = [], tree.children

    def noted(store, base, folder, ignores):
        listed.append(folder)
        return plain(store, base, folder, ignores)

    monkeypatch.setattr(tree, "children", noted)
    reader = tree.TreeSource({"path": str(root), "ignores": tree.json.dumps(IGNORES)}).reader(None)
    got = [row[0] for part in reader.partitions() for row in reader.read(part)]
    assert len(got) == len(set(got)) and WANTED | {"deep/link.py"} <= set(got)
    assert not {f for f in listed if f.split("/")[0] in ("node_modules", "gen") or "venv" in f or "loop" in f}
    assert "gen_not" in listed and "" in listed


def test_scan_reads_names_that_other_sources_hide(spark, root):
    got = {r.path: r.content for r in files.scan(spark, str(root), ignores=IGNORES, max_bytes=50).collect()}
    assert set(got) == WANTED | {"deep/link.py"}
    assert got["big.py"] is None and got["empty.py"] == "" and got["a b/c.py"] == "y = 2\n" and got["deep/link.py"] == "x = 1\n"
    assert {r.path for r in files.scan(spark, f"file://{root}/pkg").collect()} == {"__init__.py", "_hidden.py"}


def test_missing_and_empty_roots(spark, tmp_path):
    assert files.scan(spark, str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="nothing-here"):
        files.scan(spark, str(tmp_path / "nothing-here")).collect()


def test_the_tree_as_a_stream(spark, root, tmp_path):
    seen = []

    def run():
        seen.clear()
        stream = watch.changes(watch.tree_stream(spark, str(root), ignores=IGNORES), "modified")
        watch.watch(stream, lambda batch, n: seen.extend((r.path, r.content) for r in batch.collect()), str(tmp_path / "cp")).awaitTermination()
        return sorted(seen)

    assert {p for p, _ in run()} == WANTED | {"deep/link.py"}
    (root / "empty.py").write_text("now = 1\n")
    (root / "big.py").unlink()
    assert run() == [("empty.py", "now = 1\n")]  # what the overlap reads again is no change
    known = spark.createDataFrame([(p,) for p in WANTED], "path string")
    assert [tuple(r) for r in watch.gone(known, spark, str(root), ignores=IGNORES).collect()] == [("big.py", None, None, True)]
