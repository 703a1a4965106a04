"""Graph queries don't store or shuffle what they ask little of."""

import pytest
from codeloom.functions import text
from codeloom.operators import fts, traverse
from codeloom.plans import derived, queries
from codeloom.sources import staging
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_single_queries_store_no_index(spark):
    queries.QUERIES["search_like_ranked"](spark, SF).collect()
    queries.QUERIES["trace_1hop"](spark, SF).collect()
    assert not [k for _, k in staging._STORED if k in (f"trigrams of {SF}", f"calls of {SF}")]


def test_both_kinds_of_edge_come_from_one_join(spark):
    plan = derived._edges(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 9
    one = spark.createDataFrame([("a", "b", 3)], "x string, y string, n int")
    got = {(r.src, r.dst, r.kind, r.meta.line) for r in derived._two_edges(one, F.col("x"), F.col("y"), F.col("n"), "tests", True).collect()}
    assert got == {("a", "b", "calls", 3), ("b", "a", "tests", None)} and derived._two_edges(one, F.col("x"), F.col("y"), F.col("n"), "tests", True).schema["meta"].dataType.names == derived._edge(one, F.col("x"), F.col("y"), "calls").schema["meta"].dataType.names


def test_a_hop_shuffles_no_nodes(spark, tmp_path):
    """Five calls among 60,000 nodes, which are too many to be sent whole: only the calls' own nodes meet them."""
    many = derived._node(spark.range(60_000), F.concat(F.lit("symbol:"), F.col("id").cast("string")), "symbol", F.concat(F.lit("n"), F.col("id").cast("string")), F.sha2(F.col("id").cast("string"), 512))
    many.write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    calls = spark.createDataFrame([(f"symbol:{i}", f"symbol:{i + 1}", i) for i in range(5)], "a string, b string, n int")
    edges = staging.stage(derived._edge(calls, F.col("a"), F.col("b"), "calls", F.col("n")), "edges")
    start = spark.createDataFrame([("symbol:0", 1)], "id string, place int")
    seen, real = [], traverse.stage
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "512k")

        def noted(df, name):
            seen.append((name, df._jdf.queryExecution().sparkPlan().toString()))
            return real(df, name)

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(traverse, "stage", noted)
            hops = traverse.trace_hops(nodes, edges, start, 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert [[list(r.path) for r in made.collect()] for made, _ in hops] == [[["symbol:0", "symbol:1"]], [["symbol:0", "symbol:1", "symbol:2"]]]
    assert not [name for name, plan in seen if "SortMergeJoin" in plan]


def test_targets_found_exactly_match_no_parts(spark):
    nodes = derived.nodes(spark, SF)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(traverse, "name_hits", lambda *a: 1 / 0)
        assert [r.id for r in traverse.resolve_targets(nodes, "supplier/3").collect()] == ["file:supplier/3"]


def test_semantic_search_stores_no_postings_and_scores_alike(spark):
    queries.QUERIES["semantic_search"](spark, SF).collect()
    assert not [k for _, k in staging._STORED if k in (f"node postings of {SF}", f"node lengths of {SF}")]
    fields, terms = ("name", "path", "body"), text.expand_query("create nation thing the tion")
    docs = fts.index_documents(queries._doc_nodes(spark, SF))
    want = fts.bm25(fts.postings(docs, fields), fts.doc_lengths(docs, fields), terms)
    want, got = ({r.node_id: round(r.bm25, 9) for r in x.collect()} for x in (want, fts.bm25_once(docs, terms, fields=fields)))
    assert got and got == want
