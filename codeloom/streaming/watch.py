"""Watching source files as a stream: changed files are parsed again and merged, removed ones forgotten."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from codeloom.schema import FILES
from codeloom.sources import files, tree

STORE = "spark.sql.streaming.stateStore.providerClass"
#: State that processors keep needs this store.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

CHANGES = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.StringType()), T.StructField("sha1", T.StringType()), T.StructField("gone", T.BooleanType())])


def file_stream(spark: SparkSession, folder: str, fmt: str = "parquet", schema=FILES) -> DataFrame:
    """New files of a landing folder as rows (path, content)."""
    return spark.readStream.schema(schema).format(fmt).load(folder)


def tree_stream(spark: SparkSession, root: str, overlap: float = tree.OVERLAP, **filters) -> DataFrame:
    """(path, content, modified) of the files below ``root`` as they change; ``changes`` takes out what comes twice.

    A file that is removed sends no row; ``gone`` finds those."""
    return files.read(files.listing(spark, root, stream=True, overlap=overlap, **filters), root)


def gone(known: DataFrame, spark: SparkSession, root: str, **filters) -> DataFrame:
    """Rows of ``changes`` for the paths of ``known`` (path) that the tree doesn't have any more."""
    there = files.listing(spark, root, **filters).select("path")
    text = F.lit(None).cast("string")
    return known.select("path").distinct().join(there, "path", "left_anti").select("path", text.alias("content"), text.alias("sha1"), F.lit(True).alias("gone"))


class LastSeen(StatefulProcessor):
    """The digest of each path's last content. A path that goes leaves no state behind."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("sha1", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        before = last
        seen = pd.concat(list(rows)).sort_values("place", kind="stable")
        out = []
        for content, sha1 in zip(seen["content"], seen["sha1"]):
            sha1 = None if pd.isna(sha1) else sha1
            if sha1 != last:
                out.append((key[0], content if sha1 else None, sha1, sha1 is None))
                last = sha1
        if last is None:
            self.last.clear()
        elif last != before:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=CHANGES.names).astype({"gone": bool})

    def close(self) -> None:
        pass


def changes(stream: DataFrame, order: str | None = None) -> DataFrame:
    """(path, content, sha1, gone) of rows whose content is not the path's last one: A, B, A are three changes.

    Null content means that the file is gone. Rows of a path that come together are taken by the column
    ``order``, if one is named. What is kept is a digest for each path that is there.
    """
    rows = stream.select("path", "content", F.sha1(F.encode("content", "UTF-8")).alias("sha1"), (F.col(order) if order else F.lit(0)).cast("double").alias("place"))
    return rows.groupBy("path").transformWithStateInPandas(LastSeen(), CHANGES, "Update", "None")


def watch(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None):
    """Start the query: each batch goes to ``merge``, which must be idempotent (a batch may come twice after a
    failure). Without ``seconds`` it takes what there is and ends."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:  # a query keeps the settings that it starts with
        writer = stream.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(STORE, before)


def latest(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of a batch's rows with equal keys the last by ``order``."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *[F.col(f"r.{c}") for c in rest])
