"""Command line: ``python -m codeloom.plans.cli --repo PATH COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys
import time

from codeloom.operators import providers, vectors
from codeloom.plans import server
from codeloom.plans.engine import SHORT, Engine, brief
from codeloom.schema import NODE_KINDS
from codeloom.sources import catalog


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="codeloom", description="Code graphs of repositories on Spark.")
    top.add_argument("--repo", help="repository; else the nearest root around the working folder")
    top.add_argument("--json", action="store_true", help="print JSON")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *positional: str, limit: int | None = None, vendor: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        for x in positional:
            p.add_argument(x)
        if limit is not None:
            p.add_argument("--limit", type=int, default=limit)
        if vendor:
            p.add_argument("--include-vendor", action="store_true")
        return p

    p = add("init", "write a configuration")
    p.add_argument("--storage", choices=("global", "local"), default="global")
    p.add_argument("--update", choices=("manual", "commit", "watch", "interval"), default="manual")
    p.add_argument("--force", action="store_true")
    p.add_argument("--gitignore", action="store_true")
    p = add("index", "build the graph")
    p.add_argument("--no-reset", action="store_true")
    p.add_argument("--no-embed", action="store_true")
    add("status", "counts, health and age")
    add("update", "index again if the policy says so")
    p = add("watch", "index again and again by the policy")
    p.add_argument("--once", action="store_true")
    add("search", "find nodes", "term", limit=20)
    p = add("semantic", "rank nodes", "query", limit=8)
    p.add_argument("--kind", choices=NODE_KINDS)
    p.add_argument("--path-glob")
    p.add_argument("--no-group", action="store_true")
    p.add_argument("--term-only", action="store_true", help="the local ranker, whatever vectors there are")
    p.add_argument("--provider", choices=sorted(vectors.MODELS))
    p.add_argument("--model")
    p = add("embed", "make vectors")
    p.add_argument("--provider", choices=sorted(vectors.MODELS))
    p.add_argument("--model")
    p.add_argument("--dimensions", type=int)
    p.add_argument("--force", action="store_true")
    add("symbol", "find symbols", "name", limit=20)
    add("impact", "dependents and dependencies", "target", limit=50, vendor=True)
    add("callers", "what calls it", "target", limit=50, vendor=True)
    add("callees", "what it calls", "target", limit=50, vendor=True)
    p = add("trace", "call paths", "source", vendor=True)
    p.add_argument("--to")
    p.add_argument("--max-hops", type=int, default=3)
    p.add_argument("--limit", type=int)
    add("tests", "related tests", "path", limit=50)
    p = add("explain", "a topic in short", "topic", limit=12)
    p.add_argument("--depth", type=int, default=1)
    add("serve", "answer JSON-RPC on standard input")
    p = add("install", "add the server to a client's configuration", "config")
    p.add_argument("--name", default="codeloom")
    p.add_argument("--workspace-env", action="store_true")
    p = add("repos", "registered repositories")
    p.add_argument("--set-default")
    p = add("register", "add a repository", "path")
    p.add_argument("--name")
    add("unregister", "remove a repository", "name")
    return top


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def text_of(payload) -> str:
    """A result for people: nodes a line each, other values as key and value."""

    def line(x) -> str:
        if isinstance(x, dict) and "id" in x:
            place = f" {x['path']}" + (f":{x['line']}" if x.get("line") else "") if x.get("path") else ""
            return f"{x['kind']:8} {x['name']}{place}" + (f"  {x['score']}" if "score" in x else "")
        return json.dumps(x, default=str, sort_keys=True)

    if isinstance(payload, list):
        return "\n".join(map(line, payload)) or "nothing found"
    out = []
    for k, v in payload.items():
        out += [f"{k}:", *(f"  {line(x)}" for x in v)] if isinstance(v, list) and v else [f"{k}: {line(v)}"]
    return "\n".join(out)


def _embed(engine: Engine, args: argparse.Namespace) -> dict:
    name, model, size = vectors.provider_choice(args.provider, args.model, args.dimensions)
    if name == "local":
        return engine.embed(model, size, args.force)
    return engine.embed(force=args.force, dimensions=size or 0, provider=providers.connect(name, model, size))


def run(args: argparse.Namespace, spark=None):
    """The command's result; a string for one that fails."""
    repo = args.repo or catalog.find_root(".")
    registry = catalog.Registry()
    if args.command == "repos":
        if args.set_default:
            registry.set_default(args.set_default)
        return {"default": registry.default, "repos": [{"name": k, **v} for k, v in sorted(registry.repos.items())]}
    if args.command == "register":
        return {"registered": registry.register(args.path, args.name)}
    if args.command == "unregister":
        name = next((n for n, r in registry.repos.items() if args.name in (n, r["path"])), args.name)
        return {"removed": registry.unregister(name)}
    if args.command == "install":
        return server.install(args.config, args.name, repo=args.repo, workspace_env=args.workspace_env)
    if args.command == "init":
        config = catalog.load_config(repo)
        from pathlib import Path

        if Path(repo, catalog.CONFIG_FILE).exists() and not args.force:
            return f"{catalog.CONFIG_FILE} exists; --force overwrites it"
        config.storage, config.update = args.storage, {"mode": args.update}
        return {"written": catalog.write_config(config, args.gitignore)}
    engine = Engine.open(spark or _spark(), repo)
    if args.command == "serve":
        server.serve(engine.spark, args.repo)
        return {}
    if args.command == "index":
        return engine.index(reset=not args.no_reset, embed=False if args.no_embed else None)
    if args.command == "update":
        return engine.update()
    if args.command == "watch":
        while True:
            result = engine.update()
            if args.once:
                return result
            print(json.dumps(result, default=str), flush=True)
            time.sleep(int(engine.config.update.get("interval_seconds", catalog.WATCH_SECONDS)))
    if not engine.tables.exists():
        return f"no graph at {engine.config.tables}: index the repository first"
    vendor = getattr(args, "include_vendor", False)
    return {
        "status": lambda: engine.status(),
        "search": lambda: engine.search(args.term, args.limit),
        "semantic": lambda: engine.ask(args.query, args.limit, args.kind, args.path_glob, not args.no_group, args.provider, args.model, args.term_only),
        "embed": lambda: _embed(engine, args),
        "symbol": lambda: engine.symbols(args.name, args.limit),
        "impact": lambda: engine.impact(args.target, args.limit, vendor),
        "callers": lambda: engine.callers(args.target, args.limit, vendor),
        "callees": lambda: engine.callees(args.target, args.limit, vendor),
        "trace": lambda: engine.trace(args.source, args.to, args.max_hops, args.limit, vendor),
        "tests": lambda: engine.tests(args.path, args.limit),
        "explain": lambda: brief(engine.explain(args.topic, args.limit, args.depth), SHORT),
    }[args.command]()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    result = run(args)
    if isinstance(result, str):
        print(result, file=sys.stderr)
        return 2
    print(json.dumps(result, indent=2, sort_keys=True, default=str) if args.json else text_of(result))
    return 0


if __name__ == "__main__":
    sys.exit(main())
