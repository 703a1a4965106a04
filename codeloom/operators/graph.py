"""The graph's tables: assembly from records, upserts, statistics, health and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.text import top_terms
from codeloom.operators import resolve
from codeloom.schema import EDGES, NODES, edge_meta, file_id, node_meta, route_id, symbol_id
from codeloom.sources.files import describe, glob_regex


def last_wins(rows: DataFrame, keys: list[str], seq: Column | str) -> DataFrame:
    """Upsert: of rows with equal ``keys`` the one with the greatest ``seq``; the aggregate combines map-side."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in rest])


def first_wins(rows: DataFrame, keys: list[str], seq: Column | str) -> DataFrame:
    """Insert or ignore: of rows with equal ``keys`` the one with the least ``seq``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in rest])


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """A snapshot with ``new`` rows in place of rows with the same id; vanished nodes stay."""
    return old.join(new.select("id").distinct(), "id", "left_anti").unionByName(new)


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """A snapshot with the edges that weren't there; known ones keep their first meta."""
    keys = ["src", "dst", "kind"]
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def _seq(*parts: Column | str) -> Column:
    return F.struct(*parts)


def assemble(files: DataFrame, records: DataFrame, features: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``files`` (path, content) and their ``records``.

    Files without content have no node, but imports, features and tests may still mean their path.
    """
    known = files.select("path").distinct()
    kept = records.select("path")
    imported = resolve.imports(records, known)
    symbols = records.select("path", F.posexplode("symbols").alias("seq", "s")).select("path", "seq", "s.*")
    docs = first_wins(records.select("path", F.posexplode("docs").alias("n", "d")).select("path", "n", "d.*"), ["path", "name"], "n").drop("n")
    routes = records.select("path", F.posexplode("routes").alias("seq", "r")).select("path", "seq", "r.method", F.col("r.path").alias("route"), "r.handler")

    neighbors = imported.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "neighbor"))), lambda x: x.neighbor).alias("neighbors"))
    texts = describe(files).join(kept, "path", "left_semi")
    terms = top_terms(texts.select(F.col("path").alias("id"), F.col("content").alias("text"))).withColumnRenamed("id", "path")
    file_nodes = (
        records.join(texts.select("path", "sha1", "size", "is_test"), "path").join(neighbors, "path", "left").join(terms, "path", "left")
        .select(
            file_id(F.col("path")).alias("id"),
            F.when(F.col("is_test"), "test").otherwise("file").alias("kind"),
            F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
            "path",
            F.lit(None).cast("int").alias("line"),
            node_meta(
                sha1=F.col("sha1"), size=F.col("size"), terms=F.coalesce("terms", F.array()), docstring=F.col("module_doc"), body_preview=F.col("header"),
                exports=F.transform("symbols", lambda x: x["name"]), routes=F.transform("routes", lambda r: F.concat(F.upper(r.method), F.lit(" "), r.path)),
                neighbors=F.coalesce("neighbors", F.array()),
            ).alias("meta"),
        )
    )
    symbol_nodes = last_wins(symbols, ["path", "name"], "seq").join(docs, ["path", "name"], "left").select(
        symbol_id(F.col("path"), F.col("name")).alias("id"),
        F.lit("symbol").alias("kind"),
        "name",
        "path",
        "line",
        node_meta(
            symbol_kind=F.col("kind"), signature=F.col("signature"), docstring=F.col("docstring"), decorators=F.col("decorators"), body_preview=F.col("body_preview"), parent=F.col("parent")
        ).alias("meta"),
    )
    packages = imported.where(F.col("dst").startswith("package:")).select("dst").distinct()
    package_nodes = packages.select(
        F.col("dst").alias("id"), F.lit("package").alias("kind"), F.expr("substring(dst, 9)").alias("name"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"), node_meta().alias("meta")
    )
    handled = routes.join(docs.select("path", F.col("name").alias("handler"), "docstring", "signature"), ["path", "handler"], "left")
    label = F.concat(F.upper("method"), F.lit(" "), F.col("route"))
    route_nodes = last_wins(
        handled.select(
            route_id(F.col("method"), F.col("route")).alias("id"),
            F.lit("route").alias("kind"),
            label.alias("name"),
            "path",
            F.lit(None).cast("int").alias("line"),
            node_meta(
                method=F.upper("method"), route=F.col("route"), handler=F.col("handler"),
                docstring=F.when(F.col("handler").isNotNull(), F.coalesce("docstring", F.lit(""))), signature=F.coalesce("signature", "handler"),
            ).alias("meta"),
            "seq",
        ),
        ["id"], _seq("path", "seq"),
    ).drop("seq").select("id", "kind", "name", "path", "line", "meta")
    nodes = file_nodes.unionByName(symbol_nodes).unionByName(package_nodes).unionByName(route_nodes)

    called = resolve.calls(records, known)
    edges = first_wins(
        symbols.select(file_id(F.col("path")).alias("src"), symbol_id(F.col("path"), F.col("name")).alias("dst"), F.lit("defines").alias("kind"), edge_meta().alias("meta"), "path", "seq")
        .unionByName(imported.select(file_id(F.col("path")).alias("src"), "dst", F.lit("imports").alias("kind"), edge_meta(**{"import": F.col("raw")}).alias("meta"), "path", "seq"))
        .unionByName(routes.select(route_id(F.col("method"), F.col("route")).alias("src"), file_id(F.col("path")).alias("dst"), F.lit("handled_by").alias("kind"), edge_meta().alias("meta"), "path", "seq"))
        .unionByName(called.select("src", "dst", F.lit("calls").alias("kind"), edge_meta(line=F.col("line"), name=F.col("name"), qualifier=F.col("qualifier")).alias("meta"), "path", "seq"))
        .unionByName(resolve.tests(known).select("src", "dst", F.lit("tests").alias("kind"), edge_meta().alias("meta"), F.lit("").alias("path"), F.lit(0).alias("seq"))),
        ["src", "dst", "kind"], _seq("path", "seq"),
    ).drop("path", "seq")
    if features:
        feature_nodes, contains = feature_tables(known, features)
        nodes, edges = nodes.unionByName(feature_nodes), edges.unionByName(contains)
    return nodes, edges


def feature_tables(known: DataFrame, features: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Feature nodes, and their edges to the files that a glob of theirs matches. Patterns are configuration,
    so each feature is one filter of the files and no join."""
    spark = known.sparkSession
    rows = [(name, list(patterns)) for name, patterns in features.items()]
    named = spark.createDataFrame(rows, "name string, patterns array<string>")
    nodes = named.select(
        F.concat(F.lit("feature:"), "name").alias("id"), F.lit("feature").alias("kind"), "name", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"), node_meta(patterns=F.col("patterns")).alias("meta")
    )
    matching = F.array_compact(F.array(*[F.when(F.col("path").rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns) or "(?!)"), F.lit(name)) for name, patterns in rows]))
    edges = known.select("path", F.explode(matching).alias("feature")).select(
        F.concat(F.lit("feature:"), "feature").alias("src"), file_id(F.col("path")).alias("dst"), F.lit("contains").alias("kind"), edge_meta().alias("meta")
    )
    return nodes, edges


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)


def kind_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("kind").agg(F.count("*").alias("n"))


def stats(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """(key, n): a row per node kind, then ``nodes``, ``edges`` and ``embeddings``."""
    out = nodes.groupBy(F.col("kind").alias("key")).agg(F.count("*").alias("n"))
    out = out.unionByName(nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("key"), "n"))
    out = out.unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("key"), "n"))
    if embeddings is not None:
        out = out.unionByName(embeddings.agg(F.count("*").alias("n")).select(F.lit("embeddings").alias("key"), "n"))
    return out


def fts_health(nodes: DataFrame, fts_rows: int, sample: int = 200) -> dict:
    """Whether the text index is filled, and how rich the first nodes' documentation is."""
    first = nodes.orderBy("id").limit(sample)
    rich = F.concat_ws("", "meta.docstring", "meta.signature", "meta.body_preview")
    got = first.agg(F.count("*").alias("n"), F.count(F.when(F.trim(rich) != "", 1)).alias("rich")).first()
    warnings = []
    if got.n and not fts_rows:
        warnings.append("the text index is empty: rebuild it")
    if got.n and not got.rich:
        warnings.append("no documentation, signatures or bodies among the first nodes: index again")
    return {"rows": fts_rows, "rich_sample": got.rich, "sampled": got.n, "warnings": warnings}


def pending(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """``documents`` (node_id, content_sha1) whose content has no stored embedding yet."""
    return documents.join(stored.select("node_id", "content_sha1"), ["node_id", "content_sha1"], "left_anti")


def ranked(rows: DataFrame, partition: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
