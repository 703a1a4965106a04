"""Tables of the code graph, ids, and the orders of node kinds. One source of truth for all modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_KINDS = ("file", "test", "symbol", "package", "route", "feature")
EDGE_KINDS = ("defines", "imports", "handled_by", "calls", "contains", "tests")

_text = ("symbol_kind", "parent", "signature", "docstring", "body_preview", "method", "route", "handler", "sha1", "import")
_lists = ("decorators", "exports", "routes", "neighbors", "imports", "terms", "patterns")

NODE_META = T.StructType(
    [T.StructField(n, T.StringType()) for n in _text]
    + [T.StructField("size", T.IntegerType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in _lists]
)
EDGE_META = T.StructType(
    [T.StructField("line", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("qualifier", T.StringType()), T.StructField("import", T.StringType())]
)
NODES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("meta", NODE_META),
    ]
)
EDGES = T.StructType(
    [T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("meta", EDGE_META)]
)
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.StringType())])
EMBEDDINGS = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("dimensions", T.IntegerType()),
        T.StructField("content_sha1", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType(), False)),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def node_meta(**given: Column) -> Column:
    """A node's meta struct with the given fields, the others null."""
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in NODE_META])


def edge_meta(**given: Column) -> Column:
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EDGE_META])


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_id(path: Column, name: Column) -> Column:
    return F.concat(F.lit("symbol:"), path, F.lit(":"), name)


def route_id(method: Column, path: Column) -> Column:
    return F.concat(F.lit("route:"), F.upper(method), F.lit(" "), path)


def kind_order(kind: str | Column = "kind") -> Column:
    """The order of lexical queries: symbols, routes, files, then all others alike."""
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k == "symbol", 0).when(k == "route", 1).when(k == "file", 2).otherwise(3)


def kind_rank(kind: str | Column = "kind") -> Column:
    """The order of ranked results, which also tells tests from packages."""
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k == "symbol", 0).when(k == "route", 1).when(k == "file", 2).when(k == "test", 3).when(k == "package", 4).otherwise(9)


def first_line(c: Column) -> Column:
    return F.split(F.trim(c), "\n")[0]


def compact_meta(meta: str = "meta", kind: str = "kind") -> Column:
    """The reduced meta that every query returns: what each kind of node shows, lists cut short."""
    m, k = F.col(meta), F.col(kind)
    is_file, is_symbol, is_route = k.isin("file", "test"), k == "symbol", k == "route"
    other = ~is_file & ~is_symbol & ~is_route

    def cut(name: str, n: int) -> list[Column]:
        c = m[name]
        return [
            F.when(is_file, F.slice(c, 1, n)).alias(name),
            F.when(is_file & (F.size(c) > n), F.lit(True)).alias(f"{name}_truncated"),
        ]

    return F.struct(
        *cut("routes", 8),
        *cut("exports", 12),
        *cut("neighbors", 8),
        F.when(is_file, m["sha1"]).alias("sha1"),
        F.when(is_file, m["size"]).alias("size"),
        F.when(is_file, first_line(m["docstring"])).when(is_route, m["docstring"]).alias("docstring"),
        F.when(is_symbol | other, m["symbol_kind"]).alias("symbol_kind"),
        F.when(is_symbol | other, m["parent"]).alias("parent"),
        F.when(is_symbol | is_route, first_line(m["signature"])).alias("signature"),
        F.when(is_route | other, m["method"]).alias("method"),
        F.when(is_route | other, m["route"]).alias("route"),
        F.when(is_route | other, m["handler"]).alias("handler"),
        F.when(other, m["import"]).alias("import"),
        F.when(other, m["patterns"]).alias("patterns"),
    )
