"""Configuration, the registry of repositories, snapshots of tables, metadata and staleness.

Configuration and registry are small files of the user's machine. Tables may lie in any store that Spark reads.
"""

from __future__ import annotations

import json
import os
import subprocess
import time
import uuid
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources import shared_files
from codeloom.sources.files import EXTENSIONS, IGNORES
from codeloom.sources.layers import Conflict, Layered, hash_bucket

CONFIG_FILE = "codeloom.config.json"
LOCAL_DIR = ".codeloom"
HOME_ENV, REPO_ENV = "CODELOOM_HOME", "CODELOOM_REPO"
WATCH_SECONDS = 300
SCHEMA_VERSION = 3


@dataclass
class Config:
    repo: str
    storage: str = "global"
    update: dict = field(default_factory=lambda: {"mode": "manual"})
    extensions: list[str] = field(default_factory=lambda: list(EXTENSIONS))
    ignore: list[str] = field(default_factory=lambda: list(IGNORES))
    features: dict[str, list[str]] = field(default_factory=dict)
    embed: dict = field(default_factory=lambda: {"auto": True})

    @property
    def tables(self) -> str:
        """Folder of the repository's tables: in the repository, or below the user's home by its path."""
        if self.storage == "local":
            return f"{self.repo}/{LOCAL_DIR}/tables"
        return str(home() / "repos" / repo_key(self.repo) / "tables")


def home() -> Path:
    return Path(os.environ.get(HOME_ENV) or Path.home() / LOCAL_DIR)


def repo_key(path: str) -> str:
    return path.translate(str.maketrans("/ :", "___"))


def find_root(start: str) -> str:
    """The nearest folder upwards that has a configuration or is a checkout; else ``start`` itself."""
    here = Path(start).resolve()
    return str(next((p for p in (here, *here.parents) if (p / CONFIG_FILE).exists() or (p / ".git").exists()), here))


def load_config(repo: str) -> Config:
    """The repository's configuration; built-in ignores stay in force beside its own."""
    config, path = Config(repo=str(Path(repo).resolve())), Path(repo) / CONFIG_FILE
    if path.exists():
        given = json.loads(path.read_text())
        for name in ("storage", "extensions", "features", "embed"):
            if name in given:
                setattr(config, name, given[name])
        if "update" in given:
            config.update = given["update"] if isinstance(given["update"], dict) else {"mode": given["update"]}
        config.ignore = list(dict.fromkeys([*given.get("ignore", []), *IGNORES]))
    return config


def write_config(config: Config, gitignore: bool = False) -> str:
    path = Path(config.repo) / CONFIG_FILE
    path.write_text(json.dumps({k: v for k, v in asdict(config).items() if k != "repo"}, indent=2, sort_keys=True) + "\n")
    ignored = Path(config.repo) / ".gitignore"
    if gitignore and LOCAL_DIR + "/" not in (ignored.read_text().split() if ignored.exists() else []):
        with ignored.open("a") as f:
            f.write(LOCAL_DIR + "/\n")
    return str(path)


class Registry:
    """Names of repositories, with a default; one JSON file. A file that can't be read counts as empty."""

    def __init__(self, path: str | None = None):
        self.path = Path(path) if path else home() / "repos.json"
        try:
            data = json.loads(self.path.read_text())
            self.repos, self.default = dict(data["repos"]), data.get("default")
        except (OSError, ValueError, KeyError, TypeError):
            self.repos, self.default = {}, None

    def save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        new = self.path.with_suffix(f".{uuid.uuid4().hex}")
        new.write_text(json.dumps({"repos": self.repos, "default": self.default}, indent=2, sort_keys=True))
        new.replace(self.path)

    def register(self, path: str, name: str | None = None, tables: str | None = None) -> str:
        path = str(Path(path).resolve())
        known = next((n for n, r in self.repos.items() if r["path"] == path), None)
        base = name or known or Path(path).name
        chosen, n = base, 1
        while chosen in self.repos and self.repos[chosen]["path"] != path:
            n += 1
            chosen = f"{base}-{n}"
        if known and known != chosen:
            del self.repos[known]
        self.repos[chosen] = {"path": path, "tables": tables or load_config(path).tables, "indexed_at": time.time()}
        self.default = self.default if self.default in self.repos else chosen
        self.save()
        return chosen

    def unregister(self, name: str) -> bool:
        gone = self.repos.pop(name, None) is not None
        if self.default == name:
            self.default = min(self.repos, default=None)
        self.save()
        return gone

    def set_default(self, name: str) -> None:
        if name not in self.repos:
            raise KeyError(f"no repository of this name: {name}")
        self.default = name
        self.save()

    def route(self, asked: str | None = None, pinned: str | None = None, cwd: str | None = None) -> str:
        """Path of the repository that is meant: asked for, pinned, in the environment, around the working
        folder, or the default, in this order."""
        for value in (asked, pinned, os.environ.get(REPO_ENV)):
            if value:
                if value in self.repos:
                    return self.repos[value]["path"]
                if os.path.isdir(value):
                    return str(Path(value).resolve())
                raise KeyError(f"no repository of this name or path: {value}")
        paths = {r["path"] for r in self.repos.values()}
        here = Path(cwd or os.getcwd()).resolve()
        for p in (here, *here.parents):
            if str(p) in paths or (p / CONFIG_FILE).exists():
                return str(p)
        if self.default in self.repos:
            return self.repos[self.default]["path"]
        raise KeyError("no repository is registered")


def current_commit(repo: str) -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=repo, check=True, capture_output=True, text=True, timeout=20).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


class Tables:
    """A repository's tables below one folder, in any store that Spark reads: nodes, edges and embeddings as layered tables,
    and metadata. A numbered state file names the tables' manifests that belong together, so readers see one whole
    snapshot or the next, and a change writes only what it changes."""

    KEYS = {"nodes": ["id"], "edges": ["src", "dst", "kind"], "embeddings": ["node_id", "provider", "model"]}
    BUCKETS = 32
    #: What can be made from nodes and edges: folders, and layered tables.
    DERIVED = ("text", "trigrams", "calls", "vectors")
    #: States that stay behind the last one.
    KEPT = 4

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.layered = {name: Layered(spark, f"{self.folder}/{name}", key, hash_bucket(key[0], self.BUCKETS)) for name, key in self.KEYS.items()}

    def _numbers(self) -> list[int]:
        return sorted(int(n[6:-5]) for n in shared_files.names(self.spark, self.folder) if n.startswith("state-") and n.endswith(".json"))

    def _path(self, number: int) -> str:
        return f"{self.folder}/state-{number:09d}.json"

    def state(self) -> dict:
        """The last state; an empty one where there is none, or where it can't be read."""
        numbers = self._numbers()
        try:
            return json.loads(shared_files.read(self.spark, self._path(numbers[-1]))) if numbers else {"snapshots": {}, "meta": {}}
        except ValueError:
            return {"snapshots": {}, "meta": {}}

    def _save(self, state: dict) -> None:
        numbers = self._numbers()
        number = max(numbers, default=0) + 1
        if not shared_files.write_once(self.spark, self._path(number), json.dumps(state, sort_keys=True)):
            raise Conflict(self.folder)
        for old in numbers[: 1 - self.KEPT]:
            shared_files.delete(self.spark, self._path(old))

    def exists(self) -> bool:
        return "nodes" in self.state()["snapshots"]

    def write(self, **tables: DataFrame) -> None:
        """New snapshots of the given tables, seen together once all are written."""
        state = self.state()
        for name, df in tables.items():
            state["snapshots"][name] = self.layered[name].write(df)
        state["meta"] |= {"schema_version": SCHEMA_VERSION}
        self._save(state)

    def change(self, **tables: tuple[DataFrame, DataFrame | None]) -> None:
        """(rows, keys) of the given tables in place of the rows of these keys; what is not touched stays as it lies."""
        state = self.state()
        for name, (rows, keys) in tables.items():
            state["snapshots"][name] = self.layered[name].change(rows, keys, state["snapshots"].get(name))
        state["meta"] |= {"schema_version": SCHEMA_VERSION}
        self._save(state)

    def read(self, name: str) -> DataFrame | None:
        number = self.state()["snapshots"].get(name)
        return self.layered[name].read(number=number) if number else None

    def get(self, key: str, default=None):
        return self.state()["meta"].get(key, default)

    def set(self, **values) -> None:
        state = self.state()
        state["meta"] |= values
        self._save(state)

    def drop_derived(self) -> None:
        """Forget what can be made from nodes and edges; also what a newer layout asks for."""
        state = self.state()
        state["snapshots"] = {k: v for k, v in state["snapshots"].items() if k in ("nodes", "edges")}
        self._save(state)
        for name in self.DERIVED:
            shared_files.delete(self.spark, f"{self.folder}/{name}")

    def migrate(self) -> bool:
        old = self.exists() and self.get("schema_version") != SCHEMA_VERSION
        if old:
            self.drop_derived()
            self.set(schema_version=SCHEMA_VERSION)
        return old


def should_reindex(config: Config, tables: Tables, now: float | None = None) -> tuple[bool, str]:
    """Whether the graph is stale by the configured policy, and why."""
    if not tables.exists():
        return True, "missing graph"
    mode = config.update.get("mode", "manual")
    if mode == "manual":
        return False, "manual"
    if mode == "commit":
        changed = tables.get("git_commit") != current_commit(config.repo)
        return changed, "commit changed" if changed else "commit unchanged"
    if mode in ("interval", "watch"):
        due = (time.time() if now is None else now) - float(tables.get("indexed_at") or 0) >= int(config.update.get("interval_seconds", WATCH_SECONDS))
        return due, "interval elapsed" if due else "interval not elapsed"
    return False, f"unknown policy: {mode}"
