"""The engine end to end: index a folder, ask, index again; catalog, server and stream."""

import io
import json

import pytest

from codeloom.plans import cli, server
from codeloom.plans.engine import Engine
from codeloom.sources import catalog
from codeloom.streaming import watch


@pytest.fixture(scope="module")
def repo(tmp_path_factory, request):
    folder = tmp_path_factory.mktemp("repos")
    root = folder / "billing"
    for name, content in {
        "billing.py": 'def create_invoice(user):\n    """Make an invoice."""\n    return tax(user)\n\n\ndef tax(user):\n    return 1\n',
        "test_billing.py": "from billing import create_invoice\n\n\ndef test_create():\n    create_invoice(1)\n",
        "node_modules/x.js": "function hidden() {}\n",
        "notes.md": "About money.\n",
        "big.py": "x = 1\n" * 400_000,
        "bad.py": b"def caf\xff():\n    pass\n",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    patch = pytest.MonkeyPatch()
    patch.setenv(catalog.HOME_ENV, str(folder / "home"))
    request.addfinalizer(patch.undo)
    return root


@pytest.fixture(scope="module")
def engine(spark, repo):
    e = Engine.open(spark, str(repo))
    e.index()
    return e


def test_index_scans_what_it_should(engine):
    ids = {r.id for r in engine.nodes.collect()}
    assert {"file:billing.py", "file:test_billing.py", "file:notes.md", "symbol:bad.py:caf", "symbol:billing.py:create_invoice"} <= ids
    assert not any("hidden" in i or "big" in i for i in ids)
    assert engine.stats()["embeddings"] == len(ids) and engine.tables.get("last_embed")["provider"] == "local"


def test_queries(engine):
    assert [n["id"] for n in engine.search("create_inv")][:1] == ["symbol:billing.py:create_invoice"]
    best = engine.semantic("invoice creation", glob="billing.py")[0]
    assert best["name"] == "create_invoice" and best["score"] == 1.0 and best["score_source"] == "hybrid" and best["snippet"] == "Make an invoice."
    assert "terms" not in best["meta"] and engine.semantic("the and") == []
    assert [c["name"] for c in engine.callees("create_invoice")["callees"]] == ["tax"]
    assert {c["name"] for c in engine.callers("billing.py:create_invoice")["callers"]} == {"test_create"}
    assert engine.callers("nothing at all") == {"target": None, "matches": [], "callers": []}
    assert {n["path"] for n in engine.tests("billing.py")} == {"test_billing.py"}
    trace = engine.trace("test_create", max_hops=2)
    assert [(p["hops"], p["edges"][-1]["to"]) for p in trace["paths"]] == [(1, "symbol:billing.py:create_invoice"), (2, "symbol:billing.py:tax")]
    assert engine.explain("invoice")["anchor"]["name"] == "create_invoice"
    assert engine.status()["warnings"] == [] and engine.impact("billing.py")["dependents"]
    with pytest.raises(ValueError):
        engine.search("x", -1)


def test_incremental_embedding_and_merge(engine, spark):
    assert engine.embed()["embedded"] == 0
    before = engine.edges.count()
    source = spark.createDataFrame([("extra.py", "def extra():\n    pass\n")], "path string, content string")
    engine.index(source, reset=False, embed=False, register=False)
    assert engine.edges.count() == before + 1 and engine.symbols("extra")
    assert engine.embed()["embedded"] == 2


def test_staleness(engine):
    for update, now, want in (({"mode": "manual"}, None, "manual"), ({"mode": "commit"}, None, "commit unchanged"), ({"mode": "interval", "interval_seconds": 10}, 1e12, "interval elapsed"), ({"mode": "odd"}, None, "unknown policy: odd")):
        engine.config.update = update
        assert catalog.should_reindex(engine.config, engine.tables, now)[1] == want


def test_server_and_command_line(engine, repo, spark, capsys):
    requests = [{"id": 1, "method": "initialize"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "symbol", "arguments": {"name": "tax"}}}, {"id": 4, "method": "tools/call", "params": {"name": "no"}}, {"id": 5, "method": "odd"}, {"id": 6, "method": "tools/call", "params": {"name": "search", "arguments": {}}}, {"method": "notifications/initialized"}]
    out = io.StringIO()
    server.serve(spark, str(repo), io.StringIO("\n".join(map(json.dumps, requests))), out)
    answers = {a["id"]: a for a in map(json.loads, out.getvalue().splitlines())}
    assert len(answers[2]["result"]["tools"]) == 11 and json.loads(answers[3]["result"]["content"][0]["text"])[0]["name"] == "tax"
    assert [answers[i]["error"]["code"] for i in (4, 5, 6)] == [-32602, -32601, -32603]
    found = cli.run(cli.parser().parse_args(["--repo", str(repo), "symbol", "tax"]), spark)
    assert cli.text_of(found).startswith("symbol   tax billing.py:6")
    assert cli.run(cli.parser().parse_args(["--repo", str(repo.parent), "status"]), spark).startswith("no graph")


def test_registry_names_and_routes(tmp_path, monkeypatch):
    monkeypatch.setenv(catalog.HOME_ENV, str(tmp_path / "home"))
    monkeypatch.delenv(catalog.REPO_ENV, raising=False)
    for d in ("a/repo", "b/repo", "free"):
        (tmp_path / d).mkdir(parents=True)
    r = catalog.Registry()
    assert [r.register(str(tmp_path / x)) for x in ("a/repo", "b/repo", "a/repo")] == ["repo", "repo-2", "repo"] and catalog.Registry().default == "repo"
    assert r.route("repo-2") == str(tmp_path / "b/repo") and r.route(cwd=str(tmp_path / "b/repo")) == str(tmp_path / "b/repo") and r.route(cwd=str(tmp_path / "free")) == str(tmp_path / "a/repo")
    with pytest.raises(KeyError):
        r.route("unknown")
    monkeypatch.setenv(catalog.REPO_ENV, "repo-2")
    assert r.route(cwd=str(tmp_path / "free")) == str(tmp_path / "b/repo")
    assert r.unregister("repo") and r.default == "repo-2"
    r.path.write_text("{")
    assert catalog.Registry().repos == {}


def test_watch_merges_changed_files_once(spark, tmp_path):
    landing, seen = tmp_path / "in", []
    write = lambda n, rows: spark.createDataFrame(rows, "path string, content string").coalesce(1).write.parquet(str(landing / n))
    write("1", [("a.py", "x"), ("b.py", "y")])

    def run():
        watch.watch(watch.changes(watch.file_stream(spark, str(landing) + "/*")), lambda batch, n: seen.extend(r.path for r in batch.collect()), str(tmp_path / "cp")).awaitTermination()

    run()
    write("2", [("a.py", "x"), ("b.py", "new")])
    run()
    assert sorted(seen) == ["a.py", "b.py", "b.py"]


def test_short_lists_fallback_and_bad_lines(engine, monkeypatch):
    import io
    import json

    from codeloom.operators import providers
    from codeloom.plans import server
    from codeloom.plans.engine import LONG, SHORT, brief

    assert list(brief({"files": [{"id": "a", "kind": "file", "edge_kind": "calls"}]}, SHORT)["files"][0].items()) == [("kind", "file"), ("name", None), ("path", None), ("line", None), ("edge", "calls")]
    assert set(brief({"x": [{"id": "a"}], "y": 1}, LONG)["x"][0]) == set(LONG)
    found = engine.ask("invoice creation", term_only=True)
    assert found and all(x["score_source"] in ("bm25", "local-hash", "hybrid") for x in found) and "snippet" in found[0]
    sink = io.StringIO()
    server.serve(engine.spark, source=io.StringIO('{bad\n\n{"method": "tools/list", "id": 7}\n'), sink=sink)
    first, second = map(json.loads, sink.getvalue().splitlines())
    assert first["error"]["code"] == -32603 and first["id"] is None and second["id"] == 7
    sent = []

    class Answer(io.BytesIO):
        pass

    def post(request, timeout):
        sent.append((request.full_url, json.loads(request.data), timeout))
        return Answer(json.dumps({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}).encode())

    monkeypatch.setattr(providers.urllib.request, "urlopen", post)
    assert providers.connect("openai", "m", 4, {"OPENAI_API_KEY": "k"}).embed(["a", "b"]) == [[1.0], [2.0]]
    assert sent == [("https://api.openai.com/v1/embeddings", {"model": "m", "input": ["a", "b"], "dimensions": 4}, 60)]
