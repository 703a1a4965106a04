import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import warc
from codeloom.llm.common import new_path

SCHEMA = "page_id long, url string, html string, type string"


def expected(rows):
    top = {}
    for i, _, h, _ in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    out = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        again = i is not None and top[h or ""] != i
        out.append((i, len(raw), digest, "revisit" if again else "response", top[h or ""] if again else None))
    return sorted(out, key=str)


def digest_rows(spark, rows, parts=2):
    path = new_path(spark, "test-warc")
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(parts), path)
    got = warc.index(spark, path).select("page_id", "payload_bytes", "payload_digest", "type", "refers_to").collect()
    return path, sorted(map(tuple, got), key=str)


def test_round_trip_with_magic_in_payloads_over_small_splits(spark):
    rng = random.Random(3)
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = []
    for i in range(120):
        body = "".join(rng.choice(["é word ", "x" * 40, "\r\n", "\r\n\r\n", "WARC/1.1\r\n", fake, "\n"]) for _ in range(rng.randrange(0, 60)))
        rows.append((i, f"http://h/{i}", body, "t"))
    rows += [(200, None, None, None), (201, "http://u\r\nX: y", "", "t"), (202, "u", rows[5][2], "t"), (203, "u", rows[5][2], "t"), (None, "u", "null id", "t"), (3, "u", rows[3][2], "t")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path, got = digest_rows(spark, rows)
        assert got == expected(rows)
        back = {(r.page_id, r.uri): bytes(r.payload) for r in warc.read(spark, path).where("type = 'response'").collect()}
        for i, _, h, _ in rows[:120]:
            if (i, f"http://h/{i}") in back:
                assert back[i, f"http://h/{i}"] == (h or "").encode()
        assert len(back) > 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_empty_table(spark):
    assert digest_rows(spark, [])[1] == []


def test_small_payloads_are_responses_below_the_bound(spark):
    path = new_path(spark, "test-warc")
    rows = [(1, "u", "a", "t"), (2, "u", "a", "t"), (3, "u", "long", "t"), (4, "u", "long", "t")]
    warc.write(spark.createDataFrame(rows, SCHEMA), path, min_bytes=2)
    got = {r.page_id: (r.type, r.refers_to) for r in warc.index(spark, path).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_pointer_jumping_against_a_walk():
    rng = np.random.default_rng(1)
    for _ in range(50):
        offset = np.unique(rng.integers(0, 400, 60))
        successor = offset + rng.integers(1, 60, len(offset))
        follow = dict(zip(offset.tolist(), successor.tolist()))

        def walk(x):
            seen = []
            while x in follow:
                seen.append(x)
                x = follow[x]
            return x, seen

        assert warc.jump_to_exits(offset, successor).tolist() == [walk(o)[0] for o in offset.tolist()]
        entries = rng.random(len(offset)) < 0.1
        want = {o for e in offset[entries].tolist() for o in walk(e)[1]}
        assert set(offset[warc.mark_reached(offset, successor, entries)].tolist()) == want


@pytest.mark.parametrize("text", ["", "a", "é" * 99])
def test_base32(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(warc.sha1_base32(F.col("t").cast("binary")).alias("d")).first().d
    assert got == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
