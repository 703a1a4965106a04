"""Graph queries: targets, neighbours, impact, related tests, and traces of simple call paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators import trigrams
from codeloom.operators.fts import contains, name_hits
from codeloom.schema import kind_order, kind_rank
from codeloom.sources.layers import Layered, hash_bucket
from codeloom.sources.staging import stage

MAX_HOPS = 10
PREFIXES = ("symbol:", "file:", "route:")
ALL_PREFIXES = (*PREFIXES, "package:", "feature:")


def not_vendored(path: Column) -> Column:
    """No vendored folder at any depth; nodes without a path pass."""
    return path.isNull() | ~path.rlike(r"(?i)(^|/)(\.venv|venv|vendor|node_modules)/")


def resolve_targets(nodes: DataFrame, value: str, limit: int = 25, grams: Layered | None = None) -> DataFrame:
    """Nodes that ``value`` means: by id, path or name; else by an id whose prefix was left out; else by
    ``path:symbol``; else by a part of name, path or id, for which a trigram index names the candidates.
    The first of these that has rows wins; names are matched by parts only if no other has any."""
    if not value:
        return nodes.limit(0)
    exact = (F.col("id") == value) | F.coalesce(F.col("path") == value, F.lit(False)) | F.coalesce(F.col("name") == value, F.lit(False))
    place = F.when(exact, 0)
    for i, prefix in enumerate(PREFIXES, 1):
        if not value.startswith(prefix):
            place = place.when(F.col("id") == prefix + value, i)
    head, _, tail = value.rpartition(":")
    if head and not value.startswith(ALL_PREFIXES):
        place = place.when((F.col("kind") == "symbol") & (F.col("path") == head) & (F.col("name") == tail), 4)
    # written once: the nodes are read for it once, not for the least place and again for the rows
    exactly = stage(nodes.withColumn("stage", place).where("stage is not null"), "targets")
    best = exactly.agg(F.min("stage")).first()[0]
    if best is not None:
        return exactly.where(F.col("stage") == best).drop("stage")
    return name_hits(nodes, value, grams).orderBy(kind_order(), "name", "id").limit(limit)


def best_match(targets: DataFrame) -> DataFrame:
    return targets.orderBy(kind_rank(), F.coalesce("path", F.lit("")), "name", "id").limit(1)


def symbol_ids(targets: DataFrame) -> DataFrame:
    """Ids of the symbols among ``targets``, and of the best match."""
    return targets.where("kind = 'symbol'").select("id").unionByName(best_match(targets).select("id")).distinct()


def impact_ids(targets: DataFrame) -> DataFrame:
    """Ids of all targets of the best match's kind."""
    return targets.join(best_match(targets).select("kind"), "kind", "left_semi").select("id")


def _edges_with(nodes: DataFrame, edges: DataFrame, ids: DataFrame, given: str, other: str, vendor: bool) -> DataFrame:
    """Rows of the nodes at the ``other`` end of edges whose ``given`` end is among ``ids``."""
    # ids and hits are written, so that the planner knows how few they are and shuffles neither edges nor nodes for them
    hit = edges.join(stage(ids.select(F.col("id").alias(given)), "ends"), given, "left_semi").select(
        F.col(given).alias(f"{given}_id"), F.col(other).alias("id"), F.col("kind").alias("edge_kind"),
        F.col("meta.line").alias("call_line"), F.col("meta.name").alias("call_name"), F.col("meta.qualifier").alias("call_qualifier"),
    )
    rows = stage(hit, "hits").join(nodes, "id")
    return rows if vendor else rows.where(not_vendored(F.col("path")))


def callers(nodes: DataFrame, edges: DataFrame, ids: DataFrame, limit: int = 50, vendor: bool = False) -> DataFrame:
    rows = _edges_with(nodes, edges.where("kind = 'calls'"), ids, "dst", "src", vendor)
    return rows.orderBy("kind", F.asc_nulls_first("path"), F.asc_nulls_first("call_line"), "name", "id", "dst_id").limit(limit)


def callees(nodes: DataFrame, edges: DataFrame, ids: DataFrame, limit: int = 50, vendor: bool = False) -> DataFrame:
    rows = _edges_with(nodes, edges.where("kind = 'calls'"), ids, "src", "dst", vendor)
    return rows.orderBy(F.asc_nulls_first("call_line"), "kind", F.asc_nulls_first("path"), "name", "id", "src_id").limit(limit)


def dependents(nodes: DataFrame, edges: DataFrame, ids: DataFrame, limit: int = 50, vendor: bool = False) -> DataFrame:
    """Nodes that point at ``ids``, by any edge but that of definition; one row per edge."""
    rows = _edges_with(nodes, edges.where("kind <> 'defines'"), ids, "dst", "src", vendor)
    return rows.orderBy("kind", F.asc_nulls_first("path"), "name", "id", "edge_kind", "dst_id").limit(limit)


def dependencies(nodes: DataFrame, edges: DataFrame, ids: DataFrame, limit: int = 50, vendor: bool = False) -> DataFrame:
    """Nodes that ``ids`` point at, by any edge."""
    rows = _edges_with(nodes, edges, ids, "src", "dst", vendor)
    return rows.orderBy("kind", F.asc_nulls_first("path"), "name", "id", "edge_kind", "src_id").limit(limit)


def impact(nodes: DataFrame, edges: DataFrame, value: str, limit: int = 50, vendor: bool = False) -> DataFrame:
    """Dependents and dependencies of a target, told apart by ``direction``."""
    ids = stage(impact_ids(resolve_targets(nodes, value)), "impact")
    columns = ["direction", "id", "kind", "name", "path", "line", "meta", "edge_kind"]
    up = dependents(nodes, edges, ids, limit, vendor).withColumn("direction", F.lit("dependent")).select(columns)
    return up.unionByName(dependencies(nodes, edges, ids, limit, vendor).withColumn("direction", F.lit("dependency")).select(columns))


def related_tests(nodes: DataFrame, edges: DataFrame, ids: DataFrame, limit: int = 50) -> DataFrame:
    """Distinct nodes that test ``ids``: by an edge of that kind, or as test files with any edge to them."""
    rows = _edges_with(nodes, edges, ids, "dst", "src", True).where("edge_kind = 'tests' or kind = 'test'")
    return rows.select(*nodes.columns).dropDuplicates(["id"]).orderBy(F.asc_nulls_first("path"), "name", "id").limit(limit)


def symbols(nodes: DataFrame, name: str, limit: int = 20, grams: Layered | None = None) -> DataFrame:
    return trigrams.narrowed(nodes, grams, name, ("name",)).where((F.col("kind") == "symbol") & contains(F.col("name"), name)).orderBy("name", "id").limit(limit)


def default_trace_limit(max_hops: int) -> int:
    return max(25, 100 // max(1, max_hops))


#: Folders of the stored calls.
CALL_BUCKETS = 32


def call_table(spark: SparkSession, folder: str) -> Layered:
    """The stored calls of ``call_rows``, in folders by their source: a hop opens those of its ends."""
    return Layered(spark, folder, ["src"], hash_bucket("src", CALL_BUCKETS))


def call_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls with both ends known: src, dst, call_line, dst_path, and ``r`` and ``own``, the place among the source's
    calls and among those of them that touch nothing vendored (null for the others)."""
    ends = nodes.select("id", F.col("kind").alias("k"), F.col("path").alias("p"), F.col("name").alias("n"))
    calls = edges.where("kind = 'calls'").select("src", "dst", F.col("meta.line").alias("call_line"))
    rows = calls.join(ends.select(F.col("id").alias("src"), F.col("p").alias("src_path")), "src").join(ends.withColumnRenamed("id", "dst"), "dst")
    rows = rows.withColumn("kept", not_vendored(F.col("src_path")) & not_vendored(F.col("p")))
    order = [F.asc_nulls_first("call_line"), "k", F.asc_nulls_first("p"), "n", "dst"]
    r = F.row_number().over(Window.partitionBy("src").orderBy(*order))
    own = F.when(F.col("kept"), F.row_number().over(Window.partitionBy("src", "kept").orderBy(*order)))
    return rows.select("src", "dst", r.alias("r"), own.alias("own"), "call_line", F.col("p").alias("dst_path"))


def _calls_of(nodes: DataFrame, edges: DataFrame, frontier: DataFrame, vendor: bool, calls: Layered | None) -> DataFrame:
    """Ordered calls of the nodes that ``frontier`` ends in: from their folders, or made for the hop."""
    if calls is not None:
        ends = [r.b for r in frontier.select(hash_bucket("last", CALL_BUCKETS).alias("b")).distinct().collect()]
        rows = calls.read(ends)
    else:
        # each step is written, so that the planner sees how few a hop's ends, calls and nodes are: neither edges nor nodes are shuffled for them
        ends = stage(frontier.select(F.col("last").alias("src")).distinct(), "hop-ends")
        hop = stage(edges.where("kind = 'calls'").join(ends, "src", "left_semi"), "hop")
        met = stage(hop.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "hop-ids")
        rows = stage(call_rows(stage(nodes.join(met, "id", "left_semi"), "hop-nodes"), hop), "hop-calls")
    return rows.select("src", "dst", (F.col("r") if vendor else F.col("own")).alias("r"), "call_line", "dst_path").where("r is not null")


def trace_hops(
    nodes: DataFrame, edges: DataFrame, start: DataFrame, max_hops: int = 3, vendor: bool = False, calls: Layered | None = None, goals: DataFrame | None = None
) -> list[tuple[DataFrame, DataFrame]]:
    """All simple call paths from ``start`` (id, place): for each number of hops up to ``max_hops`` a staged table (path,
    call_lines, ord, last, dst_path), and its count (n). Sorted by ord a table's paths come in breadth-first order.

    A hop reads the last one's table and the calls of the nodes that its paths end in; a hot node is split by the adaptive
    planner. With ``goals`` (id, path; a null path is no file's) the last hop, which is the largest, makes the paths that
    arrive and only counts the others.
    """
    frontier = start.select(F.array("id").alias("path"), F.array().cast("array<int>").alias("call_lines"), F.array("place").alias("ord"), F.col("id").alias("last"))
    out: list[tuple[DataFrame, DataFrame]] = []
    max_hops = max(1, min(int(max_hops), MAX_HOPS))
    for hop in range(1, max_hops + 1):
        rows = _calls_of(nodes, edges, frontier, vendor, calls)

        def step(some: DataFrame) -> DataFrame:
            return (
                frontier.join(some, F.col("last") == F.col("src"))
                .where(~F.array_contains("path", F.col("dst")))
                .select(
                    F.concat("path", F.array("dst")).alias("path"), F.concat("call_lines", F.array("call_line")).alias("call_lines"),
                    F.concat("ord", F.array("r")).alias("ord"), F.col("dst").alias("last"), "dst_path",
                )
            )

        if goals is not None and hop == max_hops:
            made = stage(step(_arriving(rows, goals, "dst")), "trace")
            counted = frontier.select("path", "last").join(rows.select("src", "dst"), F.col("last") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
            out.append((made, counted.agg(F.count("*").alias("n"))))
        else:
            made = stage(step(rows), "trace")
            out.append((made, made.agg(F.count("*").alias("n"))))
        frontier = made.drop("dst_path")
    return out


def _arriving(rows: DataFrame, goals: DataFrame, end: str) -> DataFrame:
    """``rows`` that end in one of ``goals``, or in any node of a path of theirs."""
    by_id, by_path = goals.select(F.col("id").alias(end), F.lit(True).alias("_a")).distinct(), goals.where("path is not null").select(F.col("path").alias("dst_path"), F.lit(True).alias("_b")).distinct()
    return rows.join(by_id, end, "left").join(by_path, "dst_path", "left").where("_a or _b").select(*rows.columns)


def trace(
    nodes: DataFrame, edges: DataFrame, source: str, target: str | None = None, max_hops: int = 3, limit: int | None = None, vendor: bool = False, grams: Layered | None = None, calls: Layered | None = None
) -> tuple[DataFrame, DataFrame]:
    """(paths, counts) of a trace from ``source``.

    ``paths`` are the ones that reach ``target`` (any without one, or if it means nothing), ``limit`` per
    number of hops. A file as target is reached by any node of that path. Paths go on beyond a target.
    ``counts`` has explored, remaining and truncated. ``grams`` and ``calls`` are the stored indexes of nodes and calls.
    """
    max_hops = max(1, min(int(max_hops), MAX_HOPS))
    limit = default_trace_limit(max_hops) if limit is None else max(1, int(limit))
    starts = symbol_ids(stage(resolve_targets(nodes, source, grams=grams), "trace-source")).join(nodes.select("id", "kind", "path", "name"), "id")
    start = starts.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(kind_rank(), F.coalesce("path", F.lit("")), "name", "id")))
    goals = None
    if target:
        meant = resolve_targets(nodes, target, grams=grams).select("id", F.when(F.col("kind") == "file", F.col("path")).alias("path"))
        goals = stage(meant, "trace-target")
        goals = None if goals.isEmpty() else goals
    hops = trace_hops(nodes, edges, stage(start.select("id", "place"), "trace-start"), max_hops, vendor, calls, goals)
    hits = [x if goals is None else _arriving(x, goals, "last") for x, _ in hops]
    first = [x.orderBy("ord").limit(limit).select(F.lit(hop).alias("hops"), "path", "call_lines", "ord") for hop, x in enumerate(hits, 1)]
    paths = reduce(DataFrame.unionByName, first).orderBy("hops", "ord")
    total = reduce(DataFrame.unionByName, [n for _, n in hops]).agg(F.sum("n").alias("paths_explored"))
    rest = reduce(DataFrame.unionByName, [x.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("n")) for x in hits]).agg(F.sum("n").alias("paths_remaining"))
    counts = total.select("paths_explored", rest.select("paths_remaining").scalar().alias("paths_remaining")).withColumn("truncated", F.col("paths_remaining") > 0)
    return paths, counts
