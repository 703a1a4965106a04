"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources import shared_files

#: Used only where the session names no shared folder and runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"

#: Tables that one application keeps at a time.
MOST_STORED = 32

_STORED: dict[tuple[str, str], tuple[str, tuple]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session on a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/codeloom-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        shared_files.delete(df.sparkSession, df._staged_at)


def stored_folder(spark: SparkSession, key: str, build: Callable[[str], None], sources: Iterable[str] = ()) -> str:
    """The folder that ``build`` has filled, once in an application, for all that ask for ``key``.

    ``sources`` are the paths that it is made from: when a file there has another name, length or time, it is
    made anew. At most ``MOST_STORED`` folders are kept; the one asked for longest ago goes first.
    """
    at = spark.sparkContext.applicationId, key
    made_of = tuple(shared_files.fingerprint(spark, p) for p in sources)
    path, known = _STORED.pop(at, (None, None))
    if path and (known != made_of or not shared_files.exists(spark, path)):
        shared_files.delete(spark, path)
        path = None
    if not path:
        path = new_path(spark, "stored")
        build(path)
    _STORED[at] = path, made_of
    while len(_STORED) > MOST_STORED:
        (application, _), (old, _) = next(iter(_STORED.items()))
        if application == at[0]:
            shared_files.delete(spark, old)
        del _STORED[next(iter(_STORED))]
    return path


def stored(spark: SparkSession, key: str, build: Callable[[], DataFrame], by: str | None = None, sources: Iterable[str] = ()) -> DataFrame:
    """The table of ``build()`` in a ``stored_folder``, in folders by the column ``by``."""

    def write(path: str) -> None:
        writer = build().write
        (writer.partitionBy(by) if by else writer).parquet(path)

    return spark.read.parquet(stored_folder(spark, key, write, sources))
