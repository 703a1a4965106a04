"""Source files of a repository as a DataFrame."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources import tree

MAX_FILE_BYTES = 2_000_000
#: Text that a task holds before it passes a batch on, and the batch's types.
READ_BYTES, READ_TYPES = 1 << 25, (pa.string(), pa.string(), pa.int64())

#: What is scanned and what is not, unless the configuration says otherwise.
EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".json", ".md")
IGNORES = (
    ".git", ".codeloom", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    "node_modules", "dist", "build", ".next", ".turbo", "coverage", "vendor", "codeloom.config.json",
)


def glob_regex(pattern: str) -> str:
    """A glob (``*`` crosses directories) as a regular expression that both Python and Java read."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            inside = pattern[i:end].replace("\\", r"\\")
            out.append("[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]")
            i = end + 1
        else:
            out.append("\\" + c if not c.isalnum() and c not in "_/ " else c)
    return "(?s)^" + "".join(out) + "$"


def matches_glob(c: Column, pattern: str) -> Column:
    return F.coalesce(c, F.lit("")).rlike(glob_regex(pattern))


def not_ignored(path: Column, ignores: tuple[str, ...] | list[str]) -> Column:
    """No component of the path equals an entry, nor does the path match one as a glob."""
    keep = ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in ignores])) if ignores else F.lit(True)
    for pattern in ignores:
        keep = keep & ~path.rlike(glob_regex(pattern))
    return keep


def has_extension(path: Column, extensions: tuple[str, ...] | list[str]) -> Column:
    suffix = F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]+)$", 1)
    return suffix.isin(*extensions)


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(r"test\.|spec\.|_test\.|test_|/tests/|/test/")


def is_test_result(path: Column) -> Column:
    """The other test of paths, by which anchors are chosen."""
    return F.lower(F.coalesce(path, F.lit(""))).rlike(r"/test/|/tests/|test_|_test\.|\.spec\.|/spec/|/specs/")


def listing(spark: SparkSession, root: str, extensions=EXTENSIONS, ignores=IGNORES, stream: bool = False, overlap: float = tree.OVERLAP) -> DataFrame:
    """(path, length, modified) of the files below ``root`` that are asked for; paths are relative and POSIX.

    Ignored folders aren't listed. With ``stream``, a batch has the files changed since the last one, and those of
    the last ``overlap`` seconds before it once more; a file that is moved in with an older time isn't seen.
    """
    spark.dataSource.register(tree.TreeSource)
    reader = (spark.readStream if stream else spark.read).format(tree.NAME).option("ignores", json.dumps(list(ignores))).option("overlap", overlap)
    return reader.load(root).where(has_extension(F.col("path"), extensions) & not_ignored(F.col("path"), ignores))


def read(listed: DataFrame, root: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, content, modified) of listed files, as UTF-8 without the bytes that aren't; files over the cap aren't
    opened and have null, as have files that went since. A folder's files are dealt to all tasks."""

    def contents(batches):
        store, base = tree.open_tree(root)
        names = ["path", "content", "modified"]
        for batch in batches:
            rows, held = [], 0
            for path, length, modified in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "modified"))):
                text = None
                if length <= max_bytes:
                    try:
                        with store.open_input_stream(f"{base}/{path}") as file:
                            text = file.read().decode("utf-8", "ignore")
                    except FileNotFoundError:
                        pass
                rows.append((path, text, modified))
                held += len(text or "")
                if held > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), READ_TYPES)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), READ_TYPES)], names=names)

    spark = listed.sparkSession
    # a number of its own, or the few bytes of the paths would be put together in one task
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return listed.repartition(tasks, "path").mapInArrow(contents, "path string, content string, modified long")


def scan(spark: SparkSession, root: str, extensions=EXTENSIONS, ignores=IGNORES, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, content) of the files below ``root``; ``content`` is null for files over the cap."""
    return read(listing(spark, root, extensions, ignores), root, max_bytes).select("path", "content")


def describe(files: DataFrame) -> DataFrame:
    """``files`` (path, content) with sha1 of the text, size in characters, and whether it is a test."""
    return files.withColumns(
        {"sha1": F.sha1(F.encode("content", "UTF-8")), "size": F.length("content"), "is_test": is_test_path(F.col("path"))}
    )
