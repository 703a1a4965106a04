"""A tree of files as a data source: tasks list the folders, and ignored ones are never listed.

Spark's own file sources list a whole tree before a filter sees a path, and leave out names that begin
with ``_`` or ``.``, such as ``__init__.py``. This one walks through the file systems that Arrow opens by URI
(local or mounted paths, ``s3://``, ``gs://``, ``hdfs://`` where its client library is installed).
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "codeloom_tree"
#: The planner goes down until a level has this many folders; below it, tasks walk.
FOLDERS = 256
#: Tasks that one listing has at most.
TASKS = 1_024
#: Seconds by which a stream's batch reaches back before the last one's end: clocks differ, and stores round times.
OVERLAP = 10


def open_tree(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of ``root`` and its path there."""
    return arrow_fs.FileSystem.from_uri(root if ":/" in root else os.path.abspath(root))


def is_pruned(folder: str, ignores: list[str]) -> bool:
    """Whether every file below a folder is ignored: by the folder's name, or by a glob that ends in ``*``."""
    return folder.rsplit("/", 1)[-1] in ignores or any(p.endswith("*") and fnmatchcase(folder + "/", p) for p in ignores)


def children(store: arrow_fs.FileSystem, base: str, folder: str, ignores: list[str]) -> tuple[list[str], list[tuple[str, int, int]]]:
    """Folders, and files (path, length, microseconds of the last change), right below ``folder``.

    Links to folders aren't followed, links to files are files. A folder that went or can't be read is empty,
    but for the root, whose error is raised.
    """
    try:
        found = store.get_file_info(arrow_fs.FileSelector(f"{base}/{folder}" if folder else base))
    except OSError:
        if not folder:
            raise
        return [], []
    folders, files = [], []
    for info in found:
        path = f"{folder}/{info.base_name}" if folder else info.base_name
        if info.type == arrow_fs.FileType.File:
            files.append((path, info.size, info.mtime_ns // 1_000))
        elif info.type == arrow_fs.FileType.Directory and not is_pruned(path, ignores):
            if not (isinstance(store, arrow_fs.LocalFileSystem) and os.path.islink(info.path)):
                folders.append(path)
    return folders, files


@dataclass
class Folders(InputPartition):
    """Folders of one task: their own files, or with ``deep`` all below them, changed between two times."""

    folders: list[str]
    deep: bool
    since: int | None = None
    until: int | None = None


class _Walk:
    def __init__(self, options: dict):
        self.root, self.ignores = options["path"], json.loads(options.get("ignores", "[]"))
        self.overlap = int(float(options.get("overlap", OVERLAP)) * 1_000_000)

    def _plan(self, since: int | None = None, until: int | None = None) -> list[Folders]:
        """Only names of folders are held here, those of the upper levels."""
        store, base = open_tree(self.root)
        upper, level = [], [""]
        while level and len(level) < FOLDERS:
            upper += level
            level = [f for folder in level for f in children(store, base, folder, self.ignores)[0]]
        shares = min(TASKS, -(-len(upper) // 32))
        shallow = [Folders(upper[i::shares], False, since, until) for i in range(shares)]
        shares = min(TASKS, len(level))
        return shallow + [Folders(level[i::shares], True, since, until) for i in range(shares)]

    def read(self, partition: Folders) -> Iterator[tuple[str, int, int]]:
        store, base = open_tree(self.root)
        stack = list(partition.folders)
        while stack:
            folders, files = children(store, base, stack.pop(), self.ignores)
            if partition.deep:
                stack += folders
            for file in files:
                if (partition.since is None or file[2] >= partition.since) and (partition.until is None or file[2] < partition.until):
                    yield file


class TreeReader(_Walk, DataSourceReader):
    def partitions(self) -> list[Folders]:
        return self._plan()


class TreeStream(_Walk, DataSourceStreamReader):
    """Files by the time of their last change; an offset is a time, so nothing is listed to find one."""

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() // 1_000}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        return self._plan(start["until"] - self.overlap, end["until"])

    def commit(self, end: dict) -> None:
        pass


class TreeSource(DataSource):
    """Format ``codeloom_tree``: options path, ignores (a JSON list) and, of a stream, overlap (seconds)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, length long, modified long"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(self.options)
