"""The query tools over line-delimited JSON-RPC on standard input and output."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable
from typing import TextIO

from codeloom.plans.engine import LONG, Engine, brief
from codeloom.sources import catalog

PROTOCOL = "2024-11-05"

#: Tools: description, required arguments, optional arguments with their JSON types.
TOOLS = {
    "search": ("Find nodes whose name, path or id contains a text, or that refer to it.", {"query": "string"}, {"limit": "number", "fallback": "boolean"}),
    "semantic": ("Rank nodes by full text and hashed vectors together.", {"query": "string"}, {"limit": "number", "kind": "string", "path_glob": "string", "group_by_file": "boolean", "provider": "string", "model": "string"}),
    "symbol": ("Find symbols by a part of their name.", {"name": "string"}, {"limit": "number"}),
    "impact": ("What depends on a target and what it depends on.", {"target": "string"}, {"limit": "number", "include_vendor": "boolean"}),
    "callers": ("What calls a symbol or file.", {"target": "string"}, {"limit": "number", "include_vendor": "boolean"}),
    "callees": ("What a symbol or file calls, by line.", {"target": "string"}, {"limit": "number", "include_vendor": "boolean"}),
    "trace": ("Call paths from a symbol or file, to a target if one is given.", {"from": "string"}, {"to": "string", "max_hops": "number", "limit": "number", "include_vendor": "boolean"}),
    "tests": ("Tests that belong to a file or symbol.", {"path": "string"}, {"limit": "number"}),
    "explain": ("A topic's anchor and what is around it.", {"topic": "string"}, {"limit": "number", "depth": "number"}),
    "status": ("Counts, health and age of the graph.", {}, {}),
    "repos": ("Registered repositories.", {}, {}),
}


def definitions() -> list[dict]:
    out = []
    for name, (text, needed, more) in TOOLS.items():
        types = needed | more | ({} if name == "repos" else {"repo": "string"})
        schema = {"type": "object", "properties": {k: {"type": t} for k, t in types.items()}, "required": list(needed), "additionalProperties": False}
        out.append({"name": name, "description": text, "inputSchema": schema})
    return out


class Server:
    def __init__(self, spark, pinned: str | None = None, registry: str | None = None):
        self.spark, self.pinned, self.registry = spark, pinned, registry

    def call(self, name: str, args: dict):
        if name == "repos":
            r = catalog.Registry(self.registry)
            try:
                current = r.route(args.get("repo"), self.pinned)
            except KeyError:
                current = None
            rows = [{"name": k, **v, "indexed": catalog.Tables(self.spark, v["tables"]).exists()} for k, v in sorted(r.repos.items())]
            return {"repos": rows, "default": r.default, "current": current, "pinned": self.pinned, "spawn_cwd": os.getcwd()}
        try:
            repo = catalog.Registry(self.registry).route(args.get("repo"), self.pinned)
        except KeyError as e:
            return {"error": str(e.args[0])}
        engine = Engine.open(self.spark, repo)
        if not engine.tables.exists():
            return {"error": f"no graph at {engine.config.tables}", "repo": repo, "hint": f"codeloom --repo {repo} index"}
        payload = self._tool(name)(engine, args)
        return {"repo": repo, **payload} if isinstance(payload, dict) else payload

    @staticmethod
    def _tool(name: str) -> Callable[[Engine, dict], object]:
        def limit(a: dict, n: int) -> int:
            return int(a.get("limit", n))

        def search(e: Engine, a: dict):
            found, source = e.search(a["query"], limit(a, 20)), "lexical"
            if not found and a.get("fallback", True):
                found, source = e.semantic(a["query"], limit(a, 20)), "semantic_fallback"
            return {"query": a["query"], "source": source, "results": found}

        vendor = lambda a: bool(a.get("include_vendor", False))
        return {
            "search": search,
            "semantic": lambda e, a: e.ask(a["query"], limit(a, 8), a.get("kind"), a.get("path_glob"), a.get("group_by_file", True), a.get("provider"), a.get("model")),
            "symbol": lambda e, a: e.symbols(a["name"], limit(a, 20)),
            "impact": lambda e, a: e.impact(a["target"], limit(a, 50), vendor(a)),
            "callers": lambda e, a: e.callers(a["target"], limit(a, 50), vendor(a)),
            "callees": lambda e, a: e.callees(a["target"], limit(a, 50), vendor(a)),
            "trace": lambda e, a: e.trace(a["from"], a.get("to"), a.get("max_hops", 3), a.get("limit"), vendor(a)),
            "tests": lambda e, a: e.tests(a["path"], limit(a, 50)),
            "explain": lambda e, a: brief(e.explain(a["topic"], limit(a, 12), int(a.get("depth", 1))), LONG),
            "status": lambda e, a: e.status(),
        }[name]

    def handle(self, request: dict) -> dict | None:
        method, number = request.get("method"), request.get("id")

        def failed(code: int, text: str) -> dict:
            return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": text}}

        if method == "notifications/initialized":
            return None
        if method == "initialize":
            result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "codeloom", "version": "0.1.0"}}
        elif method == "tools/list":
            result = {"tools": definitions()}
        elif method == "tools/call":
            params = request.get("params") or {}
            name, args = params.get("name"), params.get("arguments") or {}
            if name not in TOOLS:
                return failed(-32602, f"unknown tool: {name}")
            try:
                payload = self.call(name, args)
            except Exception as e:  # noqa: BLE001  a failed call is an answer of its own
                return failed(-32603, f"{type(e).__name__}: {e}")
            result = {"content": [{"type": "text", "text": json.dumps(payload, indent=2, default=str)}]}
        else:
            return failed(-32601, f"unknown method: {method}")
        return {"jsonrpc": "2.0", "id": number, "result": result}


def serve(spark, pinned: str | None = None, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    server = Server(spark, pinned)
    for line in source:
        if line.strip():
            try:
                answer = server.handle(json.loads(line))
            except Exception as e:  # noqa: BLE001  a line that is no request has an answer too, and the next one counts
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32603, "message": str(e)}}
            if answer is not None:
                print(json.dumps(answer), file=sink, flush=True)


def install(path: str, name: str = "codeloom", command: str = "codeloom", repo: str | None = None, workspace_env: bool = False) -> dict:
    """Add an entry for this server to a client's JSON configuration; other entries stay."""
    from pathlib import Path

    file = Path(path)
    config = json.loads(file.read_text()) if file.exists() else {}
    entry: dict = {"command": command, "args": [*(["--repo", repo] if repo else []), "serve"]}
    if workspace_env:
        entry["env"] = {catalog.REPO_ENV: "${workspaceFolder}"}
    config.setdefault("mcpServers", {})[name] = entry
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps(config, indent=2) + "\n")
    return entry
