"""Tables in buckets and layers: a change writes what it changes, readers merge.

A layered table is a base, in a Parquet folder with a sub-folder for each bucket, and changes, in few files each. A change
names the keys that it replaces: their rows in older layers no longer count. A reader that asks for buckets
opens their folders only, and takes from each layer what no later one has replaced. After
``MOST_LAYERS`` changes the next one writes a new base.

A manifest lists the layers; a new one is a new file, seen whole or not at all, through Hadoop's file
system. Layers that the last manifests don't name any more are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from codeloom.sources import shared_files

MOST_LAYERS = 8
#: Manifests, and what they name, that stay readable after newer ones.
KEPT = 4


def hash_bucket(by: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(n)).cast("int")


def buckets_of(spark: SparkSession, values: Iterable[str], n: int) -> list[int]:
    """Buckets of a query's few values."""
    values = sorted(set(values))
    if not values:
        return []
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(hash_bucket("v", n).alias("b")).distinct().collect()
    return sorted(r.b for r in rows)


class Conflict(Exception):
    """Another writer was first: read again and repeat."""


def _as_is(rows: DataFrame) -> DataFrame:
    return rows


class Layered:
    """A table below ``folder``. Rows with equal ``key`` columns are replaced together; ``bucket`` is an expression of the rows.

    What is stored may be packed: ``pack`` makes stored rows of rows, ``unpack`` takes them apart again; ``bucket`` is then
    one of stored rows, and ``key`` of those taken apart. Of a ``placed`` table a base too is written where its rows are made, a file
    for each task in order of buckets: nothing is shuffled, and a reader takes its buckets' pages from all files.
    """

    def __init__(
        self, spark: SparkSession, folder: str, key: list[str], bucket: Column, pack: Callable[[DataFrame], DataFrame] = _as_is, unpack: Callable[[DataFrame], DataFrame] = _as_is, most_layers: int = MOST_LAYERS, placed: bool = False
    ):
        self.spark, self.folder, self.key, self.bucket = spark, folder.rstrip("/"), key, bucket
        self.pack, self.unpack, self.most_layers, self.placed = pack, unpack, most_layers, placed

    # ---- manifests ------------------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in shared_files.names(self.spark, self.folder) if n.startswith("manifest-") and n.endswith(".json"))

    def _manifest(self, number: int) -> str:
        return f"{self.folder}/manifest-{number:09d}.json"

    def state(self, number: int | None = None) -> dict:
        """The last manifest, or that of ``number``."""
        numbers = self._numbers()
        if number is None:
            number = numbers[-1] if numbers else 0
        return json.loads(shared_files.read(self.spark, self._manifest(number))) if number else {"number": 0, "layers": [], "schema": None, "meta": {}}

    def exists(self) -> bool:
        return bool(self._numbers())

    def _commit(self, state: dict) -> int:
        number = max(self._numbers(), default=0) + 1
        if not shared_files.write_once(self.spark, self._manifest(number), json.dumps(state | {"number": number}, sort_keys=True)):
            raise Conflict(self.folder)
        self.expire()
        return number

    def expire(self, kept: int = KEPT) -> list[str]:
        """Delete manifests but the last ``kept``, and layers that these don't name; returns the layers' paths."""
        numbers = self._numbers()
        old, live = numbers[:-kept], numbers[-kept:]
        layers = lambda ns: {x[k] for n in ns for x in json.loads(shared_files.read(self.spark, self._manifest(n)))["layers"] for k in ("rows", "keys") if x[k]}
        gone = sorted(layers(old) - layers(live))
        for path in [*gone, *map(self._manifest, old)]:
            shared_files.delete(self.spark, path)
        return gone

    # ---- writing --------------------------------------------------------------------------------

    def _layer(self, rows: DataFrame, keys: DataFrame | None) -> dict:
        """A base has a folder for each bucket; a change, which is small, lies in few files in order of buckets."""
        path = f"{self.folder}/rows-{uuid.uuid4().hex}"
        rows = rows.withColumn("_bucket", self.bucket)
        if keys is None and self.placed:
            rows.sortWithinPartitions("_bucket").write.parquet(path)
            return {"rows": path, "keys": None, "buckets": None}
        if keys is None:
            # a bucket's rows come together; the adaptive planner splits large ones and joins small ones
            rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path)
            held = sorted(int(n.partition("=")[2]) for n in shared_files.names(self.spark, path) if n.startswith("_bucket="))
            return {"rows": path, "keys": None, "buckets": held}
        rows.hint("rebalance").sortWithinPartitions("_bucket").write.parquet(path)
        named = f"{self.folder}/keys-{uuid.uuid4().hex}"
        keys.select(*self.key).distinct().hint("rebalance").write.parquet(named)
        return {"rows": path, "keys": named, "buckets": None}

    def write(self, rows: DataFrame, **meta) -> int:
        """A new base in place of all that was; returns the manifest's number."""
        stored = self.pack(rows)
        return self._commit({"layers": [self._layer(stored, None)], "schema": stored.schema.json(), "meta": meta})

    def change(self, rows: DataFrame, keys: DataFrame | None = None, since: int | None = None, **meta) -> int:
        """``rows`` in place of those of ``keys``, which may name more than ``rows`` has: those rows just go. Without
        ``keys`` they are those of ``rows``. The change follows the manifest ``since``, or the last one."""
        state = self.state(since)
        if not state["layers"]:
            return self.write(rows, **meta)
        layer = self._layer(self.pack(rows).select(*StructType.fromJson(json.loads(state["schema"])).names), rows if keys is None else keys)
        state = state | {"layers": [*state["layers"], layer], "meta": state["meta"] | meta}
        number = self._commit(state)
        return self.compact() if len(state["layers"]) > self.most_layers else number

    def compact(self) -> int:
        """One base of all layers."""
        state = self.state()
        return self._commit(state | {"layers": [self._layer(self.pack(self.read()), None)]})

    # ---- reading --------------------------------------------------------------------------------

    def meta(self, name: str, default=None, number: int | None = None):
        return self.state(number)["meta"].get(name, default)

    def read(self, buckets: Iterable[int] | None = None, packed: bool = False, number: int | None = None) -> DataFrame:
        """All rows, or those of ``buckets``. ``packed`` rows are as they are stored, replaced ones among them."""
        state = self.state(number)
        text = json.loads(state["schema"])
        schema = StructType.fromJson(text)
        wanted = None if buckets is None else set(buckets)

        def rows(layer: dict) -> DataFrame:
            if layer["buckets"] is None:
                found = self.spark.read.schema(StructType.fromJson(text).add("_bucket", IntegerType())).parquet(layer["rows"])
                found = (found if wanted is None else found.where(F.col("_bucket").isin(sorted(wanted)))).drop("_bucket")
            else:
                paths = [f"{layer['rows']}/_bucket={b}" for b in layer["buckets"] if wanted is None or b in wanted]
                found = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
            return found if packed else self.unpack(found)

        first, *later = state["layers"]
        out = rows(first)
        for layer in later:
            if not packed:
                out = out.join(self.spark.read.parquet(layer["keys"]), self.key, "left_anti").select(*out.columns)
            out = out.unionByName(rows(layer))
        return out

    def files(self) -> list[int]:
        """Number of data files of each layer."""
        folders = [[x["rows"]] if x["buckets"] is None else [f"{x['rows']}/_bucket={b}" for b in x["buckets"]] for x in self.state()["layers"]]
        return [sum(n.endswith(".parquet") for f in layer for n in shared_files.names(self.spark, f)) for layer in folders]
