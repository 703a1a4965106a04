"""A code graph made from the star-schema tables, so that graph queries run at any scale and SQL can check them.

Parts and orders are symbols, customers files, suppliers tests, nations packages, regions features, pages routes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.schema import edge_meta, node_meta
from codeloom.sources.staging import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paths(sf_dir: str, *names: str) -> list[str]:
    """Where the tables ``names`` lie, or all that the graph is made of."""
    names = names or ("part", "orders", "customer", "supplier", "nation", "region", "pages", "lineitem")
    return [f"{sf_dir}/{n}.parquet" for n in names]


def _node(df: DataFrame, node_id, kind: str, name, path=None, line=None, **meta) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        node_id.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), (none if path is None else path).alias("path"), (F.lit(None) if line is None else line).cast("int").alias("line"), node_meta(**meta).alias("meta")
    )


def _edge(df: DataFrame, src, dst, kind: str, line=None) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), edge_meta(line=F.lit(None) if line is None else line).alias("meta"))


def _two_edges(df: DataFrame, src, dst, line, other: str, back: bool) -> DataFrame:
    """A call and an edge of kind ``other``, or ``back`` from its end, of each row: its joins are made once for both."""
    ends = df.select(src.alias("a"), dst.alias("b"), edge_meta(line=line).alias("m"), edge_meta(line=F.lit(None)).alias("none"))
    edge = lambda s, d, kind, meta: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), F.lit(kind).alias("kind"), F.col(meta).alias("meta"))
    return ends.select(F.inline(F.array(edge("a", "b", "calls", "m"), edge(*("ba" if back else "ab"), other, "none"))))


def cat(*parts) -> F.Column:
    return F.concat(*[F.lit(p[1:]) if p.startswith("=") else F.col(p).cast("string") for p in parts])


HOST = r"^[a-z]+://([^/?#:]+)"
PART, ORDER = ("=symbol:part/", "p_brand", "=:", "p_partkey"), ("=symbol:orders/", "o_orderpriority", "=:", "o_orderkey")
CUSTOMER, SUPPLIER = ("=file:customer/", "c_mktsegment", "=/", "c_custkey"), ("=file:supplier/", "s_suppkey")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's nodes, written once in an application as an index run would."""
    return stored(spark, f"nodes of {sf_dir}", lambda: _nodes(spark, sf_dir), sources=paths(sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, f"edges of {sf_dir}", lambda: _edges(spark, sf_dir), sources=paths(sf_dir))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    host = F.regexp_extract("url", HOST, 1)
    out = [
        _node(t("part"), cat(*PART), "symbol", F.col("p_name"), cat("=part/", "p_brand"), F.col("p_size")),
        _node(t("orders"), cat(*ORDER), "symbol", cat("=order_", "o_orderkey"), cat("=orders/", "o_orderpriority")),
        _node(t("customer"), cat(*CUSTOMER), "file", F.col("c_name"), cat("=customer/", "c_mktsegment", "=/", "c_custkey")),
        _node(t("supplier"), cat(*SUPPLIER), "test", F.col("s_name"), cat("=supplier/", "s_suppkey")),
        _node(t("nation"), cat("=package:", "n_name"), "package", F.col("n_name")),
        _node(t("region"), cat("=feature:", "r_name"), "feature", F.col("r_name")),
        _node(t("pages"), cat("=route:GET ", "url"), "route", cat("=GET ", "url")),
        _node(t("pages").select(host.alias("host")).distinct(), cat("=file:pages/", "host"), "file", F.col("host"), cat("=pages/", "host")),
    ]
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    orders, customer, part, supplier, nation, region = (t(n) for n in ("orders", "customer", "part", "supplier", "nation", "region"))
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    bought = orders.join(customer, orders.o_custkey == customer.c_custkey)
    # lines are dealt once by the key that both their grouping and the join after it go by
    held = lines.select("l_orderkey", "l_partkey", "l_linenumber").repartition("l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("line"))
    held = held.join(orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    made = lines.select("l_partkey", "l_suppkey", "l_linenumber").repartition("l_partkey").groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("line"))
    made = made.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(supplier.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    package = cat("=package:", "n_name")
    out = [
        _two_edges(bought, cat(*CUSTOMER), cat(*ORDER), F.col("o_orderkey"), "defines", False),
        _edge(held, cat(*ORDER), cat(*PART), "calls", F.col("line")),
        _two_edges(made, cat(*PART), cat(*SUPPLIER), F.col("line"), "tests", True),
        _edge(customer.join(nation, customer.c_nationkey == nation.n_nationkey), cat(*CUSTOMER), package, "imports"),
        _edge(supplier.join(nation, supplier.s_nationkey == nation.n_nationkey), cat(*SUPPLIER), package, "imports"),
        _edge(nation.join(region, nation.n_regionkey == region.r_regionkey), cat("=feature:", "r_name"), package, "contains"),
        _edge(t("pages").withColumn("host", F.regexp_extract("url", HOST, 1)), cat("=route:GET ", "url"), cat("=file:pages/", "host"), "handled_by"),
    ]
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_


#: The same graph for DuckDB, as the beginning of a WITH clause.
SQL = r"""
nodes AS (
  SELECT 'symbol:part/' || p_brand || ':' || p_partkey AS id, 'symbol' AS kind, p_name AS name, 'part/' || p_brand AS path, CAST(p_size AS INTEGER) AS line FROM part
  UNION ALL SELECT 'symbol:orders/' || o_orderpriority || ':' || o_orderkey, 'symbol', 'order_' || o_orderkey, 'orders/' || o_orderpriority, NULL FROM orders
  UNION ALL SELECT 'file:customer/' || c_mktsegment || '/' || c_custkey, 'file', c_name, 'customer/' || c_mktsegment || '/' || c_custkey, NULL FROM customer
  UNION ALL SELECT 'file:supplier/' || s_suppkey, 'test', s_name, 'supplier/' || s_suppkey, NULL FROM supplier
  UNION ALL SELECT 'package:' || n_name, 'package', n_name, NULL, NULL FROM nation
  UNION ALL SELECT 'feature:' || r_name, 'feature', r_name, NULL, NULL FROM region
  UNION ALL SELECT 'route:GET ' || url, 'route', 'GET ' || url, NULL, NULL FROM pages
  UNION ALL SELECT DISTINCT 'file:pages/' || regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), 'file', regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), 'pages/' || regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), NULL FROM pages
), held AS (
  SELECT 'symbol:orders/' || o_orderpriority || ':' || o_orderkey AS src, 'symbol:part/' || p_brand || ':' || p_partkey AS dst, min(l_linenumber) AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), made AS (
  SELECT 'symbol:part/' || p_brand || ':' || p_partkey AS src, 'file:supplier/' || s_suppkey AS dst, min(l_linenumber) AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
), bought AS (
  SELECT 'file:customer/' || c_mktsegment || '/' || c_custkey AS src, 'symbol:orders/' || o_orderpriority || ':' || o_orderkey AS dst, o_orderkey AS line
  FROM orders JOIN customer ON o_custkey = c_custkey
), edges AS (
  SELECT src, dst, 'calls' AS kind, CAST(line AS INTEGER) AS line FROM bought
  UNION ALL SELECT src, dst, 'defines', NULL FROM bought
  UNION ALL SELECT src, dst, 'calls', CAST(line AS INTEGER) FROM held
  UNION ALL SELECT src, dst, 'calls', CAST(line AS INTEGER) FROM made
  UNION ALL SELECT dst, src, 'tests', NULL FROM made
  UNION ALL SELECT 'file:customer/' || c_mktsegment || '/' || c_custkey, 'package:' || n_name, 'imports', NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'file:supplier/' || s_suppkey, 'package:' || n_name, 'imports', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'feature:' || r_name, 'package:' || n_name, 'contains', NULL FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'route:GET ' || url, 'file:pages/' || regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), 'handled_by', NULL FROM pages
), calls AS (
  SELECT e.src, e.dst, e.line AS call_line, d.path AS dst_path,
         row_number() OVER (PARTITION BY e.src ORDER BY e.line NULLS FIRST, d.kind, d.path NULLS FIRST, d.name, e.dst) AS r
  FROM edges e JOIN nodes s ON e.src = s.id JOIN nodes d ON e.dst = d.id WHERE e.kind = 'calls'
)"""
