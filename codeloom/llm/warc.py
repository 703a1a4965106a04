"""WARC archives with revisit records, read back by boundary-chain verification.

Writing is one pass of Spark's text writer: a row is a record, the line separator is the two line
ends that close one. Reading splits files anywhere: Spark's text reader, told that the magic line is
its separator, hands out the pieces between magics of each file split, payload bytes untouched. A
piece that parses as a record is a candidate whose successor is where its Content-Length says that it
ends. Within each split, pointer jumping finds where every candidate's chain leaves the split; between
splits, doubling over those exits finds the entries that the start of the file reaches; only what
they reach is a record. A magic inside a payload starts a piece that no chain arrives at.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import stage

#: Fixed values of the format.
MAGIC, LINE, END = "WARC/1.1\r\n", "\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

DATE = "2000-01-01T00:00:00Z"


def sha1_base32(c: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five hexadecimal digits are four of base 32."""
    h = F.sha1(c)
    groups = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) below ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is a
    response, the others are revisits of it and carry no block. A null html is an empty payload; rows
    with a null page_id are responses. Extra columns are ignored; an empty table writes no record.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", sha1_base32(F.col("html").cast("binary")))
    keys = own.where((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "bytes", "digest")
    first = keys.groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).where("low < refers_to").drop("low")
    # usually few: as a table its size is known, and the join with the pages is a broadcast only if it is small
    again = stage(keys.join(first, ["digest", "bytes"]).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct(), "warc-revisits")
    rows = own.join(again, ["page_id", "digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{LINE}WARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">{LINE}WARC-Date: {date}{LINE}WARC-Target-URI: "),
        uri,
        F.lit(f"{LINE}WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{LINE}WARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(f">{LINE}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit(f"{LINE}X-Payload-Length: "),
        F.col("bytes"),
        F.lit(f"{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.when(revisit, F.lit(0)).otherwise(F.col("bytes")),
        F.lit(END),
        F.when(revisit, "").otherwise(F.col("html")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)(?:\r\n|\Z)")
_PAGE = re.compile(rb"<urn:page:(\d+)>")


def _parse(piece: bytes) -> tuple[dict[bytes, bytes], int, int] | None:
    """Headers of a piece (a record without its magic), where its block begins, the block's length."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    headers = {m[1].lower(): m[2] for m in _HEADER.finditer(piece, 0, end)}
    length = headers.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 18 or b"warc-type" not in headers:
        return None
    return headers, end + 4, int(length)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces between magics, in order within each split of each file."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))


def _walk(batches):
    """(file, split, place in the split, bytes) of each piece of a task's batches."""
    last, place = None, 0
    for batch in batches:
        files, splits, pieces = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for i, at in enumerate(zip(files, splits)):
            if at != last:
                last, place = at, 0
            piece = pieces[i].as_buffer()
            piece = piece.to_pybytes() if piece is not None else b""
            yield (*at, place, piece)
            place += len(piece) + len(MAGIC)


_FIELDS = "type string, page_id long, refers_to long, uri string, payload_bytes long, payload_digest string, declared string, complete boolean"


def _described(headers: dict[bytes, bytes], block: bytes | None) -> tuple:
    def page(name: bytes) -> int | None:
        m = _PAGE.fullmatch(headers.get(name, b""))
        return int(m[1]) if m else None

    kind = headers[b"warc-type"].decode("utf-8", "replace")
    declared = headers.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("utf-8", "replace")
    size = digest = None
    if kind == "revisit":
        size, digest = int(headers.get(b"x-payload-length", b"0") or 0), declared
    elif block is not None:
        size, digest = len(block), base64.b32encode(hashlib.sha1(block).digest()).decode()
    uri = headers.get(b"warc-target-uri", b"").decode("utf-8", "replace")
    return kind, page(b"warc-record-id"), page(b"warc-refers-to"), uri, size, digest, declared, block is not None


def _candidates(batches):
    """A row per piece: its place and size, and as a candidate its length and description."""
    names = [f.split()[0] for f in ("file string, split long, place long, size long, length long, " + _FIELDS).split(", ")]
    types = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    rows: list[tuple] = []

    def flush():
        columns = zip(*rows) if rows else [[]] * len(names)
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        rows.clear()
        return out

    for file, split, place, piece in _walk(batches):
        size, parsed = len(piece) + len(MAGIC), _parse(piece)
        if parsed is None:
            rows.append((file, split, place, size, *[None] * 9))
        else:
            headers, begin, length = parsed
            whole = begin + length + len(END)
            fits = whole == len(piece) and piece.endswith(b"\r\n\r\n")
            rows.append((file, split, place, size, whole + len(MAGIC), *_described(headers, piece[begin : begin + length] if fits else None)))
        if len(rows) >= 10_000:
            yield flush()
    yield flush()


def jump_to_exits(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """For each candidate the first pointer of its chain that is no candidate; offsets are sorted."""
    n = len(offset)
    at = np.minimum(np.searchsorted(offset, successor), max(n - 1, 0))
    inside = offset[at] == successor
    jump, exits = np.where(inside, at, np.arange(n)), np.where(inside, -1, successor)
    last = ~inside
    while not last[jump].all():
        jump = jump[jump]
    return exits[jump]


def mark_reached(offset: np.ndarray, successor: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Candidates that a chain from ``entries`` (flags) reaches; by doubling the jumps."""
    n = len(offset)
    at = np.minimum(np.searchsorted(offset, successor), max(n - 1, 0))
    jump = np.where(offset[at] == successor, at, np.arange(n))
    reached = entries.copy()
    for _ in range(max(1, n).bit_length()):
        reached[jump[reached]] = True
        jump = jump[jump]
    return reached


def _pieces_with_owners(pieces: DataFrame) -> DataFrame:
    """``pieces`` with absolute ``offset``, ``reached`` and ``owner``, the record that it is part of."""
    keys = ["file", "split"]
    by_split = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = pieces.groupBy(*keys).agg(F.sum("size").alias("bytes")).select(*keys, F.coalesce(F.sum("bytes").over(by_split), F.lit(0)).alias("base"))
    placed = stage(
        pieces.join(bases, keys)
        .withColumn("offset", F.col("base") + F.col("place") - len(MAGIC))
        .withColumn("successor", F.col("offset") + F.col("length"))
        .select(*keys, "place", "offset", "successor"),
        "warc-placed",
    )

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf.successor.notna()].sort_values("offset")
        return pd.DataFrame({"file": pdf.file, "split": pdf.split, "offset": pdf.offset, "target": jump_to_exits(pdf.offset.to_numpy(np.int64), pdf.successor.to_numpy(np.int64))})

    # a group is one split of a file, whose size the reader bounds
    left = stage(placed.groupBy(*keys).applyInPandas(exits, "file string, split long, offset long, target long"), "warc-exits")
    starts = left.where("offset = 0").select("file", "offset", "target")
    # entries of later splits: candidates that some chain leaves an earlier split for
    doors = left.join(left.select("file", F.col("target").alias("offset")).distinct(), ["file", "offset"], "left_semi").select("file", "offset", "target")
    reached, jumps = starts.select("file", "offset"), doors.unionByName(starts).distinct()
    splits = placed.select(*keys).distinct().groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(0, splits - 1).bit_length()):
        step = jumps.select("file", F.col("offset").alias("at"), F.col("target").alias("next"))
        more = reached.withColumnRenamed("offset", "at").join(step, ["file", "at"]).select("file", F.col("next").alias("offset"))
        reached = stage(reached.unionByName(more).distinct(), "warc-reached")
        step = step.withColumnRenamed("at", "target")
        jumps = stage(jumps.join(step, ["file", "target"], "left").select("file", "offset", F.coalesce("next", "target").alias("target")), "warc-jumps")
    entries = reached.withColumn("entry", F.lit(True))

    def owners(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        offset = pdf.offset.to_numpy(np.int64)
        successor = pdf.successor.fillna(-1).to_numpy(np.int64)
        reached = mark_reached(offset, successor, pdf.entry.notna().to_numpy(bool))
        owner = np.maximum.accumulate(np.where(reached, offset, -1))
        return pd.DataFrame({"file": pdf.file, "split": pdf.split, "place": pdf.place, "offset": offset, "reached": reached, "owner": owner})

    owned = stage(
        placed.join(entries, ["file", "offset"], "left").groupBy(*keys).applyInPandas(owners, "file string, split long, place long, offset long, reached boolean, owner long"),
        "warc-owners",
    )
    before = owned.groupBy(*keys).agg(F.max("owner").alias("last")).select(*keys, F.max("last").over(by_split).alias("carried"))
    return owned.join(before, keys).withColumn("owner", F.when(F.col("owner") < 0, F.col("carried")).otherwise(F.col("owner"))).drop("carried")


def index(spark: SparkSession, path: str) -> DataFrame:
    """One row per verified record of the archives below ``path``: file, offset, length and
    description; payload size and digest come from the bytes read back (a revisit's, which has no
    block, from its headers).
    """
    found = stage(_pieces(spark, path).mapInArrow(_candidates, "file string, split long, place long, size long, length long, " + _FIELDS), "warc-pieces")
    owned = stage(_pieces_with_owners(found), "warc-index")
    records = owned.where("reached").join(found, ["file", "split", "place"]).drop("split", "place", "size", "reached", "owner")
    broken = stage(records.where("not complete").select("file", "offset"), "warc-broken")
    if broken.isEmpty():
        return records.drop("complete")
    # payloads with a magic in them lie in several pieces: only their bytes are read once more
    whole = payloads(spark, path, owned.join(broken.withColumnRenamed("offset", "owner"), ["file", "owner"], "left_semi"))
    sizes = whole.select("file", "offset", F.octet_length("payload").cast("long").alias("_bytes"), sha1_base32(F.col("payload")).alias("_digest"))
    return (
        records.join(sizes, ["file", "offset"], "left")
        .withColumn("payload_bytes", F.coalesce("_bytes", "payload_bytes"))
        .withColumn("payload_digest", F.coalesce("_digest", "payload_digest"))
        .drop("_bytes", "_digest", "complete")
    )


def payloads(spark: SparkSession, path: str, owned: DataFrame) -> DataFrame:
    """Blocks of the records that ``owned`` (file, split, place, offset, owner) names: file, offset, payload."""

    def raw(batches):
        rows = list()
        for x in _walk(batches):
            rows.append(x)
            if len(rows) >= 1000 or len(x[3]) > 1 << 22:
                yield _raw(rows)
                rows = []
        yield _raw(rows)

    pieces = _pieces(spark, path).mapInArrow(raw, "file string, split long, place long, piece binary")
    parts = pieces.join(owned, ["file", "split", "place"]).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("offset", "piece"))).alias("parts"))

    def joined(batches):
        for batch in batches:
            out = []
            for parts in batch.column(2).to_pylist():
                record = MAGIC.encode().join(p["piece"] for p in parts)
                parsed = _parse(record)
                out.append(record[parsed[1] : parsed[1] + parsed[2]] if parsed else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["file", "offset", "payload"])

    return parts.select("file", "owner", "parts").mapInArrow(joined, "file string, offset long, payload binary")


def _raw(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["file", "split", "place", "piece"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """``index`` with each record's ``payload`` (null for a record without a whole block)."""
    found = stage(_pieces(spark, path).mapInArrow(_candidates, "file string, split long, place long, size long, length long, " + _FIELDS), "warc-pieces")
    owned = stage(_pieces_with_owners(found), "warc-index")
    return index(spark, path).join(payloads(spark, path, owned.where("owner >= 0")), ["file", "offset"], "left")


ORACLE = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), q AS (
  SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)
    for i in range(32)], '') AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM q
"""
