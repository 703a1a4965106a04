"""Resolution and assembly on a small source tree with aliases, relative imports, ambiguous names and a second language."""

import pytest

from codeloom.operators import extract, graph, resolve

TREE = [
    ("pkg/__init__.py", ""),
    ("pkg/helpers.py", "def load():\n    return 1\n\ndef shared():\n    return load()\n"),
    ("pkg/service.py", "from . import helpers\nfrom pkg.helpers import load as fetch\nimport json\n\ndef run():\n    helpers.load()\n    fetch()\n    only_here()\n    shared()\n    json.dumps({})\n\ndef only_here():\n    return run()\n"),
    ("other.py", "def unique_name():\n    pass\n\ndef twice():\n    pass\n"),
    ("left.py", "def twice():\n    unique_name()\n    missing()\n"),
    ("test_helpers.py", "import pkg.helpers\n\ndef test_load():\n    twice()\n"),
    ("web/app.ts", "import { make } from './make'\nrouter.get('/items', make)\n"),
    ("web/make.ts", "export function make() {\n  return build()\n}\nconst build = () => 1\n"),
    ("notes.md", "call unique_name() here\n"),
]

IMPORTS = {
    ('pkg/service.py', 'file:pkg/helpers.py'),
    ('pkg/service.py', 'package:json'),
    ('test_helpers.py', 'file:pkg/helpers.py'),
    ('web/app.ts', 'file:web/make.ts'),
}
CALLS = {
    ('symbol:pkg/helpers.py:shared', 'symbol:pkg/helpers.py:load'),
    ('symbol:pkg/service.py:run', 'symbol:pkg/helpers.py:load'),
    ('symbol:pkg/service.py:run', 'symbol:pkg/service.py:only_here'),
    ('symbol:pkg/service.py:run', 'symbol:pkg/helpers.py:shared'),
    ('symbol:pkg/service.py:only_here', 'symbol:pkg/service.py:run'),
    ('symbol:left.py:twice', 'symbol:other.py:unique_name'),
    ('symbol:web/make.ts:make', 'symbol:web/make.ts:build'),
}
TESTS = {
    ('file:test_helpers.py', 'file:pkg/helpers.py'),
}


@pytest.fixture(scope="module")
def tree(spark):
    files = spark.createDataFrame(TREE, "path string, content string")
    return files, extract.extract(files)


def pairs(df, *columns):
    return {tuple(r) for r in df.select(*columns).distinct().collect()}


def test_imports_calls_and_tests(tree):
    files, records = tree
    assert pairs(resolve.imports(records, files.select("path")), "path", "dst") == IMPORTS
    assert pairs(resolve.calls(records, files.select("path")), "src", "dst") == CALLS
    assert pairs(resolve.tests(files.select("path")), "src", "dst") == TESTS


def test_assembled_edges(tree):
    edges = pairs(graph.assemble(*tree, {"web": ["web/*"]})[1], "src", "dst", "kind")
    assert {(a, b) for a, b, k in edges if k == "calls"} == CALLS and {(a, b) for a, b, k in edges if k == "tests"} == TESTS
    assert {(a, b) for a, b, k in edges if k == "imports"} == {(f"file:{a}", b) for a, b in IMPORTS}
    assert {b for a, b, k in edges if (a, k) == ("feature:web", "contains")} == {"file:web/app.ts", "file:web/make.ts"}
    assert ("route:GET /items", "file:web/app.ts", "handled_by") in edges and ("file:other.py", "symbol:other.py:twice", "defines") in edges
