"""Contracts of extraction, resolution and traversal on small source trees."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import extract, graph, hybrid, resolve, traverse


def build(spark, tree, features=None):
    files = spark.createDataFrame(list(tree.items()), "path string, content string").coalesce(1)
    nodes, edges = graph.assemble(files, extract.extract(files), features)
    return nodes.cache(), edges.cache()


def pairs(edges, kind):
    return {(r.src, r.dst) for r in edges.where(F.col("kind") == kind).collect()}


SERVICE = {
    "pkg/helpers.py": 'def load():\n    """Load it."""\n    return 1\n\n\ndef shared(x=load()):\n    return x\n',
    "pkg/vendorish.py": "def load():\n    return 2\n",
    "pkg/service.py": (
        "from pkg.helpers import load as fetch\nfrom . import helpers\nimport json\n\n\nclass Job:\n    def run(self):\n        fetch()\n        return helpers.shared()\n\n\n"
        "async def start():\n    await only()\n    load()\n    json.dumps(1)\n\n\ndef only():\n    return start()\n"
    ),
    "pkg/api.py": "@app.get('/items')\ndef items():\n    '''All.'''\n    return []\n\n@router.route('/both', methods=['PUT', 'POST'])\ndef both():\n    pass\n",
    "test_helpers.py": "import pkg.helpers\n\ndef test_load():\n    pass\n",
    "notes.md": "load() and start()\n",
    "web/server.ts": "import { make } from './make'\nimport fs from 'fs'\n\n\n// Serves.\nexport function serve() {\n  return make(1)\n}\nrouter.get('/invoices', serve)\n",
    "web/make.ts": "export const make = (x) => build(x)\nfunction build(x) {\n  return x\n}\n",
}


@pytest.fixture(scope="module")
def service(spark):
    return build(spark, SERVICE, {"web": ["web/*"]})


def test_calls_follow_imports_scopes_and_uniqueness(service):
    assert pairs(service[1], "calls") == {
        ("file:pkg/helpers.py", "symbol:pkg/helpers.py:load"),  # a default belongs to the scope around
        ("symbol:pkg/service.py:run", "symbol:pkg/helpers.py:load"),
        ("symbol:pkg/service.py:run", "symbol:pkg/helpers.py:shared"),
        ("symbol:pkg/service.py:start", "symbol:pkg/service.py:only"),
        ("symbol:pkg/service.py:only", "symbol:pkg/service.py:start"),
        ("symbol:web/server.ts:serve", "symbol:web/make.ts:make"),
        ("symbol:web/make.ts:make", "symbol:web/make.ts:build"),
    }  # load() in start is ambiguous, and prose calls nothing


def test_imports_tests_features_and_routes(service):
    nodes, edges = service
    assert pairs(edges, "imports") == {
        ("file:pkg/service.py", "file:pkg/helpers.py"), ("file:pkg/service.py", "package:json"), ("file:test_helpers.py", "file:pkg/helpers.py"),
        ("file:web/server.ts", "file:web/make.ts"), ("file:web/server.ts", "package:fs"),
    }
    assert pairs(edges, "tests") == {("file:test_helpers.py", "file:pkg/helpers.py")}
    assert pairs(edges, "contains") == {("feature:web", "file:web/server.ts"), ("feature:web", "file:web/make.ts")}
    routes = {r.name: r.meta for r in nodes.where("kind = 'route'").collect()}
    assert set(routes) == {"GET /items", "PUT /both", "POST /both", "GET /invoices"} and routes["GET /items"].handler == "items" and routes["GET /items"].docstring == "All."


def test_documentation_of_symbols_and_files(service):
    rows = {r.id: r for r in service[0].collect()}
    load = rows["symbol:pkg/helpers.py:load"]
    assert (load.line, load.meta.signature, load.meta.docstring) == (1, "def load():", "Load it.")
    assert rows["symbol:pkg/service.py:run"].meta.parent == "Job"
    serve = rows["symbol:web/server.ts:serve"]
    assert serve.line == 6 and serve.meta.docstring == "Serves." and serve.meta.signature == "export function serve() {"
    assert rows["file:test_helpers.py"].kind == "test" and rows["file:web/make.ts"].meta.exports == ["build", "make"]
    assert rows["file:pkg/service.py"].meta.neighbors == ["helpers", "helpers", "json"]


def test_callees_are_ordered_by_line(spark):
    nodes, edges = build(spark, {"s.py": "def alpha():\n    pass\n\ndef beta():\n    pass\n\ndef flow():\n    beta()\n    alpha()\n"})
    ids = traverse.symbol_ids(traverse.resolve_targets(nodes, "s.py:flow"))
    assert [(r.name, r.call_line) for r in traverse.callees(nodes, edges, ids).collect()] == [("beta", 8), ("alpha", 9)]
    assert [r.name for r in traverse.callers(nodes, edges, traverse.symbol_ids(traverse.resolve_targets(nodes, "alpha"))).collect()] == ["flow"]


def test_duplicates_last_line_first_documentation(spark):
    nodes, edges = build(spark, {"a.py": "def f():\n    'one'\n\ndef f():\n    'two'\n", "b.py": "def g():\n    f()\n", "c.py": "@app.get('/x')\ndef h(): pass\n", "d.py": "@app.get('/x')\ndef h(): pass\n"})
    row = nodes.where("id = 'symbol:a.py:f'").first()
    assert (row.line, row.meta.docstring) == (4, "one") and pairs(edges, "calls") == set()
    assert [r.path for r in nodes.where("kind = 'route'").collect()] == ["d.py"]


def test_broken_python_still_gives_its_structure():
    record = extract.parse("pkg/b.py", "from .task import work as do\nimport os, sys as s\n\ndef f(:\n    do(1)\n    s.exit()\nclass C:\n    def m(self):\n        f()\n")
    assert [(x["name"], x["kind"]) for x in record["symbols"]] == [("f", "function"), ("C", "class"), ("m", "function")]
    assert {(c["scope"], c["qualifier"], c["name"]) for c in record["calls"]} == {("f", None, "do"), ("f", "s", "exit"), ("m", None, "f")}
    assert {b["name"]: (b["module"], b["imported"]) for b in record["bindings"]} == {"do": (".task", "work"), "os": ("os", None), "s": ("sys", None)}


def test_import_candidates():
    assert extract.candidates("a.b", "x/y.py") == ["a/b.py", "a/b/__init__.py"]
    assert extract.candidates("./m.js", "web/a.ts")[0] == "web/m.js" and extract.candidates("../../x", "web/a.ts") == []
    assert "pkg/m.py" in extract.candidates("..m", "pkg/sub/a.py") and "pkg/sub/__init__.py" in extract.candidates(".", "pkg/sub/a.py")


def plain_trace(calls, starts, hops):
    out, frontier = [], [[s] for s in starts]
    for _ in range(hops):
        frontier = [p + [d] for p in frontier for d in calls.get(p[-1], []) if d not in p]
        out += frontier
    return out


def test_trace_against_a_plain_search(spark):
    rng = random.Random(6)
    names = [f"n{i}" for i in range(12)]
    calls = {n: rng.sample(names, rng.randrange(0, 4)) for n in names}
    edges = [(f"symbol:a.py:{a}", f"symbol:a.py:{b}", i) for a in names for i, b in enumerate(calls[a]) if a != b]
    e = spark.createDataFrame(edges, "src string, dst string, line int").select("src", "dst", F.lit("calls").alias("kind"), F.struct("line", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("qualifier")).alias("meta"))
    n = spark.createDataFrame([(f"symbol:a.py:{x}", "symbol", x, "a.py", 1) for x in names], "id string, kind string, name string, path string, line int")
    plain = {f"symbol:a.py:{a}": [f"symbol:a.py:{b}" for b in calls[a] if a != b] for a in names}
    want = plain_trace(plain, ["symbol:a.py:n0"], 4)
    paths, counts = traverse.trace(n, e, "n0", max_hops=4, limit=10_000)
    assert [r.path for r in paths.collect()] == want and counts.first().paths_explored == len(want)
    paths, counts = traverse.trace(n, e, "n0", max_hops=4, limit=2)
    assert counts.first().paths_remaining == sum(max(0, sum(len(p) == h + 1 for p in want) - 2) for h in range(1, 5))
    goal = "symbol:a.py:n3"
    assert [r.path for r in traverse.trace(n, e, "n0", "n3", 4, 10_000)[0].collect()] == [p for p in want if p[-1] == goal]
    assert len(traverse.trace(n, e, "n0", "nothing like it", 4, 10_000)[0].collect()) == len(want)


def test_default_limits():
    assert [traverse.default_trace_limit(h) for h in (1, 3, 10)] == [100, 33, 25]


def test_anchor_prefers_entries_to_conversions_and_tests(spark):
    rows = [("symbol:a.py:convert_invoice", "symbol", "convert_invoice", "a.py", 1, 0.9), ("symbol:a.py:create_invoice", "symbol", "create_invoice", "a.py", 5, 0.5), ("symbol:test_a.py:create_invoice", "symbol", "create_invoice", "test_a.py", 1, 1.0)]
    found = spark.createDataFrame(rows, "id string, kind string, name string, path string, line int, score double")
    assert hybrid.anchor(found, "invoice").first().id == "symbol:a.py:create_invoice"


def test_enclosing_scope(spark):
    symbols = spark.createDataFrame([("a", 3, "f"), ("a", 9, "g"), ("a", 9, "h")], "path string, line int, name string")
    calls = spark.createDataFrame([("a", 1, 0), ("a", 3, 1), ("a", 8, 2), ("a", 9, 3)], "path string, line int, row long")
    assert {r.row: r.scope for r in resolve.last_seen(symbols, calls).collect()} == {0: None, 1: "f", 2: "f", 3: "h"}


def test_script_forms_by_tokens():
    from codeloom.operators.extract import parse_script

    text = "import type {A, b} from './a'\nimport 'side'\nconst q = require('lib'); const r = require( 'spaced')\nexport * from \"./m\"\nexport { x }\nfrom 'n'\nasync function go() {\n  $(1); $log(2); 3 (4)\n}\nexport class K {}\nconst one = async (a, b) => two(a)\nlet f = async => f(1)\nrouter.post('/p', go)\nx.router.get(\"/q\")\n"
    found = parse_script(text)
    assert found["imports"] == ["./a", "side", "lib", "./m", "n"]
    assert [(n, k, line) for n, line, k in found["symbols"]] == [("go", "function", 7), ("one", "function", 11), ("f", "function", 12), ("K", "class", 10)]
    assert found["routes"] == [("post", "/p", None), ("get", "/q", None)]
    assert [(c[2], c[0], c[3]) for c in found["calls"] if c[2] in ("log", "two", "f")] == [("log", "go", 8), ("two", "one", 11), ("f", "f", 12)]
    assert parse_script("") == parse_script(" \n") | {"docs": []}
