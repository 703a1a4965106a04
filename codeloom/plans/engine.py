"""One repository's graph as an object: index it, and ask it. A thin layer over the operators."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import expand_query, reference_terms
from codeloom.operators import extract, fts, graph, hybrid, providers, snippets, traverse, trigrams, vectors
from codeloom.operators.text_index import TextIndex
from codeloom.operators.vector_index import VectorIndex
from codeloom.schema import EDGES, EMBEDDINGS, NODES, compact_meta
from codeloom.sources import catalog, files
from codeloom.sources.layers import Layered
from codeloom.sources.staging import discard, stage


def _checked(limit: int) -> int:
    if limit < 0:
        raise ValueError("a limit is 0 or more")
    return limit


#: What is left of a node in a short list: on the command line, and in a tool's answer.
SHORT = ("kind", "name", "path", "line", "edge")
LONG = ("kind", "name", "path", "line", "id", "edge", "call_line", "call_name", "call_qualifier", "score")


def brief(payload: dict, keys: tuple[str, ...]) -> dict:
    """``payload`` with its lists of nodes reduced to ``keys``; keys that a node lacks are null."""
    names = {"edge": "edge_kind"}

    def short(x):
        return {k: x.get(names.get(k, k)) for k in keys} if isinstance(x, dict) and "id" in x else x

    return {k: [short(x) for x in v] if isinstance(v, list) else v for k, v in payload.items()}


class Engine:
    def __init__(self, spark: SparkSession, config: catalog.Config):
        self.spark, self.config = spark, config
        self.tables = catalog.Tables(spark, config.tables)
        self.text = TextIndex(spark, f"{config.tables}/text")
        self.grams = trigrams.table(spark, f"{config.tables}/trigrams")
        self._calls = traverse.call_table(spark, f"{config.tables}/calls")

    @classmethod
    def open(cls, spark: SparkSession, repo: str) -> Engine:
        return cls(spark, catalog.load_config(repo))

    # ---- indexing ---------------------------------------------------------------------------

    def index(self, source: DataFrame | None = None, reset: bool = True, embed: bool | None = None, register: bool = True) -> dict:
        """Scan (or take ``source``: path, content), extract, resolve, and write all tables as new snapshots.

        Without ``reset`` new nodes replace old ones, edges keep their first meta, and nothing vanishes.
        """
        if source is None:
            source = files.scan(self.spark, self.config.repo, tuple(self.config.extensions), tuple(self.config.ignore))
        commit = catalog.current_commit(self.config.repo)
        # read and parsed once; nodes and edges take their parts from the records
        source = stage(source.select("path", "content"), "files")
        records = stage(extract.extract(source), "records")
        nodes, edges = graph.assemble(source, records, self.config.features)
        nodes, edges = stage(nodes, "nodes"), stage(edges, "edges")
        self.tables.migrate()
        before = self.tables.read("nodes") if self.text.exists() and self.grams.exists() else None
        if reset or not self.tables.exists():
            self.tables.write(nodes=nodes, edges=edges)
            if before is None:
                self._build_index()
            else:
                self._change_index(self.nodes, before.join(self.nodes, "id", "left_anti").select("id"), before)
        else:
            known = self.edges.select(*self.tables.KEYS["edges"])
            self.tables.change(nodes=(nodes, None), edges=(edges.join(known, self.tables.KEYS["edges"], "left_anti"), None))
            if before is None:
                self._build_index()
            else:
                self._change_index(self.nodes.join(nodes.select("id"), "id", "left_semi"), nodes.select("id").limit(0), before)
        discard(source, records, nodes, edges)
        counts = self.stats()
        stamp = time.time()
        result = {"files": counts.get("file", 0) + counts.get("test", 0), "symbols": counts.get("symbol", 0), **counts}
        self.tables.set(repo_root=self.config.repo, indexed_at=stamp, git_commit=commit, nodes_snapshot=self.tables.state()["snapshots"]["nodes"], last_index=result)
        if self.config.embed.get("auto", True) if embed is None else embed:
            result["embed"] = self.embed()
        if register:
            catalog.Registry().register(self.config.repo, tables=self.config.tables)
        return result

    def _build_index(self) -> None:
        self.text.build(fts.index_documents(self.nodes))
        self.grams.write(trigrams.rows(self.nodes))

    @property
    def calls(self) -> Layered:
        """The ordered calls of the current nodes and edges: made when first asked for after these have changed."""
        state = self.tables.state()["snapshots"]
        of = [state.get("nodes"), state.get("edges")]
        if not self._calls.exists() or self._calls.meta("of") != of:
            self._calls.write(traverse.call_rows(self.nodes, self.edges), of=of)
        return self._calls

    def _change_index(self, nodes: DataFrame, gone: DataFrame, before: DataFrame) -> None:
        """Index what differs between ``nodes`` and ``before``, and forget ``gone`` (id)."""
        state = F.xxhash64(*NODES.names).alias("state")
        differs = nodes.select("*", state).join(before.select("id", state), ["id", "state"], "left_anti").drop("state")
        changed, gone = stage(differs.select(*NODES.names), "changed"), stage(gone, "gone")
        if not changed.isEmpty() or not gone.isEmpty():
            self.text.update(fts.index_documents(changed), gone.withColumnRenamed("id", "node_id"))
            self.grams.change(trigrams.rows(changed), changed.select("id").unionByName(gone))
        discard(changed, gone)

    # ---- vectors ----------------------------------------------------------------------------

    @property
    def metric(self) -> str:
        """``l2`` or ``cosine``, by the configuration."""
        return self.config.embed.get("metric", "l2")

    @property
    def backend(self) -> str:
        """``indexed`` or ``brute-force``, by the configuration; both find the same neighbours."""
        return self.config.embed.get("backend", "indexed")

    def _vector_index(self, provider: str, model: str, dimensions: int, metric: str) -> VectorIndex:
        name = re.sub("[^A-Za-z0-9]+", "-", f"{provider}-{model}-{dimensions}-{metric}")
        return VectorIndex(self.spark, f"{self.config.tables}/vectors/{name}", dimensions, metric)

    def _of(self, provider: str, model: str) -> DataFrame:
        return self.embeddings.where((F.col("provider") == provider) & (F.col("model") == model))

    def neighbours(self, vector: list[float], k: int, provider: str, model: str, metric: str | None = None, backend: str | None = None) -> DataFrame:
        """The ``k`` nearest of the vectors of one provider and model, by the index where there is one for the metric."""
        metric, backend = metric or self.metric, backend or self.backend
        if backend not in ("indexed", "brute-force"):
            raise ValueError(f"no such backend: {backend}")
        index = self._vector_index(provider, model, len(vector), metric)
        if backend == "indexed" and index.exists():
            return index.search(vector, k)[0]
        return vectors.knn(self._of(provider, model), vector, k, metric)

    def embed(self, model: str = vectors.MODEL, dimensions: int = vectors.DIMENSIONS, force: bool = False, provider: vectors.Provider | None = None) -> dict:
        """Vectors for all nodes whose text has none yet; others keep theirs. Lengths of 0 are the provider's own.

        A provider that fails gives way to the local hash, and the result says so.
        """
        name, reason = (provider.name, None) if provider else ("local", None)
        if provider:
            try:
                provider.embed(["probe"])
            except Exception as e:  # noqa: BLE001  any failure of a remote service is a reason to go on locally
                name, reason, provider = "local", str(e), None
        model = provider.model if provider else model
        if not provider and dimensions <= 0:
            dimensions = vectors.DIMENSIONS
        documents = stage(vectors.semantic_text(self.nodes), "texts")
        old = self._of(name, model)
        fitting = old.where(F.col("dimensions") == dimensions) if dimensions > 0 else old
        wanted = documents if force else graph.pending(documents, fitting)
        made = vectors.embed_remote(wanted, provider) if provider else vectors.embed(wanted, model, dimensions)
        # a service is asked once for a text, whatever reads the answer
        new = stage(made.join(wanted.select("node_id", "content_sha1"), "node_id").select("node_id", F.lit(name).alias("provider"), F.lit(model).alias("model"), F.size("vector").alias("dimensions"), "content_sha1", "vector", F.current_timestamp().alias("updated_at")), "vectors")
        gone = stage(old.join(documents, "node_id", "left_anti").select(*self.tables.KEYS["embeddings"]), "gone")
        known = self.tables.read("embeddings") is not None
        embedded, vanished = new.count(), gone.count()
        if embedded or vanished or not known:
            self.tables.change(embeddings=(new, new.select(*gone.columns).unionByName(gone)))
        if self.backend == "indexed":
            for (size,) in new.select("dimensions").distinct().collect() or ([(dimensions,)] if vanished and dimensions > 0 else []):
                index = self._vector_index(name, model, size, self.metric)
                if index.exists():
                    index.upsert(new.where(F.col("dimensions") == size).select("node_id", "vector"), gone.select("node_id"))
                else:
                    index.build(self._of(name, model).select("node_id", "vector"))
        total = documents.count()
        discard(documents, new, gone)
        result = {"provider": name, "model": model, "documents": total, "embedded": embedded, "skipped": total - embedded, "fallback": reason is not None}
        if reason:
            result["fallback_reason"] = reason
        self.tables.set(last_embed=result, embedded_snapshot=self.tables.state()["snapshots"].get("nodes"))
        return result

    def forget(self, paths: DataFrame, incoming: bool = True) -> None:
        """Take the nodes of ``paths`` (path) and the edges that start at them out of tables and indexes; with
        ``incoming``, the edges that end at them too."""
        held = self.nodes.join(paths.select("path").distinct(), "path", "left_semi").select("id")
        routes = self.edges.where("kind = 'handled_by'").join(held.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
        ids = stage(held.unionByName(routes).distinct(), "forget")
        keys = self.tables.KEYS["edges"]
        ends = [self.edges.join(ids.withColumnRenamed("id", end), end, "left_semi").select(*keys) for end in (("src", "dst") if incoming else ("src",))]
        edges = stage(ends[0].unionByName(ends[-1]).distinct(), "forget")
        self.tables.change(nodes=(self.nodes.limit(0), ids), edges=(self.edges.limit(0), edges))
        if self.text.exists() and self.grams.exists():
            self._change_index(self.nodes.limit(0), ids, self.nodes)
        discard(ids, edges)

    def follow(self, batch: DataFrame, number: int = 0) -> None:
        """A batch of ``watch.changes``: changed files take the place of what they were, those that are gone are forgotten."""
        batch = stage(batch.select("path", "content", "gone"), "batch")
        if self.tables.exists():
            self.forget(batch.where("not gone"), incoming=False)
            self.forget(batch.where("gone"))
        changed = batch.where("not gone")
        if not changed.isEmpty():
            self.index(changed, reset=not self.tables.exists(), register=False)
        discard(batch)

    def update(self) -> dict:
        due, reason = catalog.should_reindex(self.config, self.tables)
        return {"updated": due, "reason": reason, **(self.index() if due else {})}

    # ---- tables -----------------------------------------------------------------------------

    def _table(self, name: str, schema) -> DataFrame:
        found = self.tables.read(name)
        return self.spark.createDataFrame([], schema) if found is None else found

    @property
    def nodes(self) -> DataFrame:
        return self._table("nodes", NODES)

    @property
    def edges(self) -> DataFrame:
        return self._table("edges", EDGES)

    @property
    def embeddings(self) -> DataFrame:
        return self._table("embeddings", EMBEDDINGS)

    def _indexed(self) -> tuple[TextIndex, Layered]:
        """Text and trigram index, made anew where they are missing or of an older layout."""
        self.tables.migrate()
        if not self.text.exists() or not self.grams.exists():
            self._build_index()
        return self.text, self.grams

    # ---- queries ----------------------------------------------------------------------------

    def _rows(self, df: DataFrame) -> list[dict]:
        if "meta" in df.columns:
            df = df.withColumn("meta", compact_meta())
        out = []
        for row in df.collect():  # results of limited queries
            d = {k: v for k, v in row.asDict(recursive=True).items() if v is not None}
            d["meta"] = {k: v for k, v in d.get("meta", {}).items() if v is not None}
            out.append(d)
        return out

    def search(self, term: str, limit: int = 20) -> list[dict]:
        index, grams = self._indexed()
        return self._rows(fts.search(self.nodes, index.of_terms(reference_terms(term)), term, _checked(limit), grams))

    def semantic(
        self, query: str, limit: int = 8, kind: str | None = None, glob: str | None = None, group: bool = True, vector: list[float] | None = None,
        provider: str = "local", model: str = vectors.MODEL, metric: str | None = None, backend: str | None = None,
    ) -> list[dict]:
        """Hybrid search; with ``vector``, its neighbours among the vectors of ``provider`` and ``model`` alone."""
        _checked(limit)
        metric = metric or self.metric

        def near(v: list[float], k: int) -> DataFrame:
            return vectors.search(self.nodes, self.embeddings, v, k, metric, kind=kind, glob=glob, near=self.neighbours(v, k, provider, model, metric, backend))

        if vector is not None:
            found = near(vector, max(limit * 8, 100)).withColumn("place", F.col("rank")).drop("rank")
            return self._rows(self._shape(found, limit, group))
        terms = expand_query(query)
        if not terms or not limit:
            return []
        candidates = fts.over_fetch(limit, glob)
        index, _ = self._indexed()
        lexical = fts.ranked(self.nodes, index.top(terms, candidates, kind=kind)[0], candidates, glob)
        if self.tables.get("embedded_snapshot") != self.tables.state()["snapshots"].get("nodes"):
            self.embed()
        provider, model = "local", vectors.MODEL
        fused = hybrid.fuse(self.nodes, lexical, near(vectors.embed_query(self.spark, query), max(candidates * 8, 100)).where(F.col("rank") <= candidates), limit * 3)
        return self._rows(self._shape(fused.withColumn("snippet", snippets.hit_snippet(terms)), limit, group))

    def ask(self, query: str, limit: int = 8, kind: str | None = None, glob: str | None = None, group: bool = True, provider: str | None = None, model: str | None = None, term_only: bool = False) -> list[dict]:
        """``semantic`` as a user asks it: by the vectors of the provider that embedded the nodes last (or of the
        one that is named), else by the local ranker, which ``term_only`` asks for. If the provider fails, the
        local ranker's results say so."""
        last = self.tables.get("last_embed", {}) or {}
        named = (provider, model) if provider or model else (last.get("provider"), last.get("model"))
        failure = None
        if not term_only:
            name, chosen, size = vectors.provider_choice(*named)
            if name != "local" and not self.embeddings.where((F.col("provider") == name) & (F.col("model") == chosen)).isEmpty():
                try:
                    vector = providers.connect(name, chosen, size).embed([query])[0]
                    return self.semantic(query, limit, kind, glob, group, vector, name, chosen)
                except Exception as e:  # noqa: BLE001  any failure of a remote service is a reason to go on locally
                    failure = str(e)
        found = self.semantic(query, limit, kind, glob, group)
        return [x | {"score_source": "bm25_fallback", "embedding_error": failure} for x in found] if failure else [{"score_source": "bm25"} | x for x in found]

    def _shape(self, found: DataFrame, limit: int, group: bool) -> DataFrame:
        return (hybrid.group_by_file(found, limit) if group else found.orderBy("place").limit(limit)).drop("place")

    def symbols(self, name: str, limit: int = 20) -> list[dict]:
        return self._rows(traverse.symbols(self.nodes, name, _checked(limit), self._indexed()[1]))

    def targets(self, value: str) -> DataFrame:
        return traverse.resolve_targets(self.nodes, value, grams=self._indexed()[1])

    def _target(self, value: str) -> tuple[dict | None, list[dict]]:
        found = self.targets(value)
        return next(iter(self._rows(traverse.best_match(found))), None), self._rows(found.limit(10))

    def callers(self, value: str, limit: int = 50, vendor: bool = False) -> dict:
        target, matches = self._target(value)
        rows = self._rows(traverse.callers(self.nodes, self.edges, traverse.symbol_ids(self.targets(value)), _checked(limit), vendor)) if target else []
        return {"target": target, "matches": matches, "callers": rows}

    def callees(self, value: str, limit: int = 50, vendor: bool = False) -> dict:
        target, matches = self._target(value)
        rows = self._rows(traverse.callees(self.nodes, self.edges, traverse.symbol_ids(self.targets(value)), _checked(limit), vendor)) if target else []
        return {"target": target, "matches": matches, "callees": rows}

    def impact(self, value: str, limit: int = 50, vendor: bool = False) -> dict:
        target, matches = self._target(value)
        if not target:
            return {"target": None, "matches": [], "dependents": [], "dependencies": []}
        ids = traverse.impact_ids(self.targets(value))
        return {
            "target": target,
            "matches": matches,
            "dependents": self._rows(traverse.dependents(self.nodes, self.edges, ids, _checked(limit), vendor)),
            "dependencies": self._rows(traverse.dependencies(self.nodes, self.edges, ids, limit, vendor)),
        }

    def trace(self, source: str, target: str | None = None, max_hops: int = 3, limit: int | None = None, vendor: bool = False) -> dict:
        start, starts = self._target(source)
        if not start:
            return {"source": None, "target": None, "paths": []}
        goal, goals = self._target(target) if target else (None, [])
        hops = max(1, min(int(max_hops), traverse.MAX_HOPS))
        paths, counts = traverse.trace(self.nodes, self.edges, source, target, hops, limit, vendor, self._indexed()[1], self.calls)
        found, total = paths.collect(), counts.first()
        ids = sorted({i for p in found for i in p.path} | {x["id"] for x in (start, goal) if x})
        shown = self._rows(self.nodes.where(F.col("id").isin(ids)))
        out = {
            "source": start,
            "target": goal,
            "max_hops": hops,
            "limit_per_hop": traverse.default_trace_limit(hops) if limit is None else max(1, int(limit)),
            "truncated": total.truncated,
            "paths_explored": total.paths_explored,
            "paths_remaining": total.paths_remaining,
            "nodes": {n["id"]: n for n in sorted(shown, key=lambda n: n["id"])},
            "paths": [{"hops": p.hops, "edges": [{"from": a, "to": b, "edge": "calls", "call_line": n} for a, b, n in zip(p.path, p.path[1:], p.call_lines)]} for p in found],
        }
        if len(starts) != 1:
            out["source_matches"] = starts
        if target and len(goals) != 1:
            out["target_matches"] = goals
        if target and not goals:
            out["warning"] = "the target means nothing here: all paths are shown"
        return out

    def tests(self, value: str, limit: int = 50) -> list[dict]:
        return self._rows(traverse.related_tests(self.nodes, self.edges, self.targets(value).select("id"), _checked(limit)))

    def explain(self, topic: str, limit: int = 12, depth: int = 1) -> dict:
        """A topic's hits, the anchor among them, and the anchor's surroundings."""
        hits, seen = [], set()
        for row in [*self.search(topic, limit), *self.semantic(topic, limit)]:
            if row["id"] not in seen and len(hits) < limit:
                seen.add(row["id"])
                hits.append(row)
        rows = [(h["id"], float(h.get("score") or 0)) for h in hits]
        scored = self.nodes.join(F.broadcast(self.spark.createDataFrame(rows, "id string, score double")), "id")  # at most ``limit`` rows
        best = next(iter(self._rows(hybrid.anchor(scored, topic))), None) if hits else None
        kinds = {k: [h for h in hits if h["kind"] == k][:n] for k, n in (("file", 5), ("symbol", 8), ("route", 5))}
        around = self.impact(best["id"], limit) if best else {"dependents": [], "dependencies": []}
        is_symbol = bool(best) and best["kind"] == "symbol"
        where = f" ({best['path']}:{best['line']})" if best and best.get("path") and best.get("line") else ""
        return {
            "topic": topic,
            "summary": f"{topic!r}: {len(hits)} hits; anchor {best['kind']} {best['name']}{where}." if best else f"{topic!r}: nothing found.",
            "anchor": best,
            "files": kinds["file"],
            "symbols": kinds["symbol"],
            "routes": kinds["route"],
            "callers": self.callers(best["id"], limit)["callers"] if is_symbol else [],
            "callees": self.callees(best["id"], limit)["callees"] if is_symbol else [],
            "trace": self.trace(best["id"], max_hops=depth, limit=limit)["paths"] if best and depth > 1 else [],
            "dependents": around["dependents"],
            "dependencies": around["dependencies"],
        }

    def stats(self) -> dict:
        out = {r.key: r.n for r in graph.stats(self.nodes, self.edges, self.embeddings).collect()}
        return out | {"vector_backend": f"{self.backend} {self.metric}"}

    def status(self) -> dict:
        health = graph.fts_health(self.nodes, self.text.totals()[0] if self.text.exists() else 0)
        commit, indexed = catalog.current_commit(self.config.repo), self.tables.get("indexed_at")
        return {
            "repo": self.config.repo,
            "tables": self.config.tables,
            "counts": self.stats(),
            "fts": health,
            "warnings": health["warnings"],
            "last_index": self.tables.get("last_index", {}),
            "last_embed": self.tables.get("last_embed", {}),
            "indexed_at": indexed,
            "indexed_at_iso": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(indexed)) if indexed else None,
            "age_seconds": int(time.time() - indexed) if indexed else None,
            "indexed_commit": self.tables.get("git_commit"),
            "current_commit": commit,
            "stale": bool(commit and self.tables.get("git_commit") and commit != self.tables.get("git_commit")),
        }
