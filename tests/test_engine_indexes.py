"""The engine's stored indexes: changed in place, the same as a rebuild; vectors by provider and model, made once."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import extract, fts, graph, trigrams, vectors
from codeloom.plans.engine import Engine
from codeloom.sources import catalog

FILES = {
    "shop/orders.py": 'def create_order(user):\n    """Make an order."""\n    return price(user)\n\n\ndef price(user):\n    return 1\n',
    "shop/users.py": "class User:\n    def name(self):\n        return 1\n",
    "shop/old.py": "def forgotten():\n    pass\n",
}


class Service:
    """A hosted provider that counts what it is asked."""

    def __init__(self, path, name="hosted", model="m1", width=3):
        self.path, self.name, self.model, self.width = path, name, model, width

    def embed(self, texts):
        with open(self.path, "a") as f:
            f.write("".join(t.replace("\n", " ") + "\n" for t in texts if t != "probe"))
        return [[1.0 if "order" in t else -1.0, float(len(t) % 7), 1.0][: self.width] for t in texts]

    def asked(self):
        try:
            with open(self.path) as f:
                return len(f.readlines())
        except FileNotFoundError:
            return 0


def source(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("home")
    with pytest.MonkeyPatch.context() as patch:
        patch.setenv(catalog.HOME_ENV, str(home))
        repo = home / "repo"
        repo.mkdir()
        e = Engine(spark, catalog.Config(repo=str(repo)))
        e.index(source(spark, FILES), register=False)
        yield e


def test_files_are_parsed_once(spark):
    files = source(spark, FILES)
    records = extract.extract(files)
    nodes, edges = graph.assemble(files, records)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(nodes).count("MapInPandas") > 1  # what the engine avoids: it stages the records
    schema = records.schema
    staged = spark.createDataFrame([], schema)
    for part in graph.assemble(files, staged):
        assert "MapInPandas" not in plan(part)


def test_a_second_index_run_changes_in_place(engine, spark):
    base = engine.text.postings.state()["layers"][0]["rows"]
    after = {k: v for k, v in FILES.items() if k != "shop/old.py"} | {"shop/orders.py": FILES["shop/orders.py"].replace("price", "total"), "shop/new.py": "def brand_new():\n    pass\n"}
    engine.index(source(spark, after), register=False)
    state = engine.text.postings.state()["layers"]
    assert state[0]["rows"] == base and len(state) == 2
    assert engine.symbols("brand") and engine.symbols("total") and not engine.symbols("forgotten") and not engine.symbols("price")
    flat = fts.postings(fts.index_documents(engine.nodes))
    want = {(r.term, r.n) for r in flat.groupBy("term").agg(F.count_distinct("node_id").alias("n")).collect()}
    assert {(r.term, r.df) for r in engine.text.frequencies().collect()} == want
    rows = lambda d: {tuple(r) for r in d.select("gram", "id", "fields").collect()}
    assert rows(engine.grams.read()) == rows(trigrams.rows(engine.nodes))
    ids = {r.id for r in engine.nodes.collect()}
    assert {r.node_id for r in engine.embeddings.collect()} == ids and engine.status()["fts"]["rows"] == len(ids)
    assert engine.index(source(spark, after), register=False)["embed"]["embedded"] == 0 and len(engine.text.postings.state()["layers"]) == 2


def test_hosted_vectors_are_made_once(engine, tmp_path):
    service, n = Service(str(tmp_path / "asked")), engine.nodes.count()
    for size, force in ((0, False), (0, False), (3, False), (3, True)):
        before = service.asked()
        result = engine.embed(dimensions=size, provider=service, force=force)
        fresh = before == 0 or force
        assert (result["embedded"], result["skipped"]) == ((n, 0) if fresh else (0, n)) and service.asked() - before == (n if fresh else 0)
        rows = engine.embeddings.where("provider = 'hosted'")
        assert rows.count() == n == rows.select("node_id").distinct().count()
    assert engine.embeddings.where("provider = 'local'").count() == n


def test_neighbours_are_those_of_the_asked_provider_and_model(engine, tmp_path):
    for model in ("m1", "m2"):
        engine.embed(dimensions=0, provider=Service(str(tmp_path / model), model=model))
    turned = engine.embeddings.where("model = 'm2'").withColumn("vector", F.transform("vector", lambda x: -x))
    engine.tables.change(embeddings=(turned, None))
    query = [1.0, 3.0, 1.0]
    for backend in ("indexed", "brute-force"):
        found = engine.semantic("x", 50, vector=query, provider="hosted", model="m1", group=False, backend=backend)
        want = vectors.knn(engine.embeddings.where("provider = 'hosted' and model = 'm1'"), query, 100).collect()
        assert {x["id"]: x["distance"] for x in found} == {r.node_id: round(r.distance, 6) for r in want}
    assert [x["id"] for x in engine.semantic("x", 5, vector=query, provider="hosted", model="m1", metric="cosine", group=False)]
    with pytest.raises(ValueError):
        engine.neighbours(query, 3, "hosted", "m1", backend="guess")


def test_status_names_backend_and_metric(engine):
    assert engine.stats()["vector_backend"] == "indexed l2"
    engine.config.embed = {"auto": True, "backend": "brute-force", "metric": "cosine"}
    assert engine.status()["counts"]["vector_backend"] == "brute-force cosine"
    assert engine.semantic("create order")[0]["name"] == "create_order"


def test_trigrams_name_all_that_match(spark):
    from codeloom.schema import node_meta

    rows = [("symbol:A/b.py:getName", "getName", "A/b.py"), ("package:É", "É", None), ("x", "ab", "a"), ("symbol:q:%_", "100%_sure", "q"), ("y", "getting a name", "n")]
    nodes = spark.createDataFrame([(i, "symbol", n, p, 1) for i, n, p in rows], "id string, kind string, name string, path string, line int").withColumn("meta", node_meta())
    import tempfile

    index = trigrams.table(spark, tempfile.mkdtemp() + "/grams")
    index.write(trigrams.rows(nodes))
    for query in ("GETN", "getname", "a/b", "get%name", "g_tn", "b.py:get", "ab", "", "100%", "é", "zzz", "get%zzz"):
        want = {r.id for r in fts.name_hits(nodes, query).collect()}
        assert {r.id for r in fts.name_hits(nodes, query, index).collect()} == want, query
    assert trigrams.pattern_grams("aB%cde_fGhi") == ["cde", "fgh", "ghi"] and trigrams.candidates(index, "a%b") is None
    assert {r.id for r in trigrams.candidates(index, "GETN", ("name",)).collect()} == {"symbol:A/b.py:getName"}
