"""Personal data in texts: base patterns, and bootstrapped contextual extraction of what they miss.

Base spans (email, ip, card, phone) are the seeds. Other spans that look like an identifier, by their digits or
an at sign, are candidates of the kinds that their shape admits. Each seed and candidate stands in contexts:
the word before it, the two words before it, the words before and after it. These make a graph of patterns
(a context and a kind) and instances (a kind and a value), which Spark scores in rounds:

* a pattern's confidence is the sum of its instances' scores over the number of different things that fill its
  context anywhere in the corpus, plain words too;
* a seed scores 1, another instance its best pattern's confidence, if that is trusted, else 0.

So seeds make patterns, patterns discover instances, and these make further patterns, of contexts too in which no
seed stands. Values count once however often they are copied.

What fills a context is counted over all texts by one more pass. It needs no list of patterns in the tasks: a
table of fixed size has for each slot of hashed contexts how many plain fillers a trusted pattern may have; a
context with more of them within a portion of texts is out, the others' fillers are counted exactly.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import discard, mix64, stage, word_hashes

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. An email is found from its at sign, so that no text takes more than linear time.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Admissible instances that a pattern needs, the confidence that is trusted, and rounds of scoring.
LEAST_SUPPORT, TRUST, ROUNDS = 4, 0.75, 3
#: Slots of the table of contexts, and words of a portion of texts.
SLOTS, PORTION = 1 << 20, 1 << 21

_WORTH = re.compile(r"[0-9@]|[\[(][aA][tT][\])]")
_TOKEN = re.compile("[^\x09-\x0d\x20:=]*[:=]|[^\x09-\x0d\x20:=]+")
_NUMBER = re.compile(r"[+(]?[0-9][0-9().+/-]*")
_AT = re.compile(r"[^\W_][^\s@]*(?:@|[\[(][aA][tT][\])])[^\s@]*[^\W_]")
_PARTS = re.compile(r"[0-9]+(?:\.[0-9]+){2,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    at = text.find("@")
    while at >= 0:
        begin = last + len(text[last:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
        last = domain.end() if domain else at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, in code points, by start and kind."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def shapes(value: str) -> int:
    """Kinds that ``value``, which is no base span, may be by its looks: a bit for each."""
    if _AT.fullmatch(value):
        return 1
    if any(c.isalpha() for c in value):
        return 0
    digits = sum("0" <= c <= "9" for c in value)
    return (2 if _PARTS.fullmatch(value) else 0) | (4 if 8 <= digits <= 19 else 0) | (8 if 6 <= digits <= 15 else 0)


def _value(span: str) -> str:
    """What makes two spans the same identifier: the digits, if it consists of them and marks between, else the whole."""
    if "@" in span or any(c.isalpha() for c in span) or _PARTS.fullmatch(span):
        return span.lower()
    return "".join(c for c in span if "0" <= c <= "9")


def _hash(span: str) -> int:
    return int.from_bytes(hashlib.blake2b(_value(span).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _raw(text: str) -> bytes:
    """``text`` with a space after each colon and equals sign, which end a word here."""
    return text.encode("utf-8", "surrogatepass").replace(b":", b": ").replace(b"=", b"= ")


def contexts(before2: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """(3, n) hashes of contexts: the word before, the two words before, the words before and after."""
    a, b, c = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        return np.stack([mix64(before * a + np.uint64(1)), mix64(before * a + mix64(before2 * b + np.uint64(2))), mix64(before * a + mix64(after * c + np.uint64(3)))])


def _edge(text: str, s: int, e: int) -> tuple[int, int]:
    """The span without what isn't a letter or digit at its ends, but with a leading plus or bracket of digits."""
    while s < e and not text[s].isalnum():
        s += 1
    while s < e and not text[e - 1].isalnum():
        e -= 1
    return s, e


def candidates(text: str, tokens: list[tuple[int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, first token, last token) of identifier-like spans that touch none of ``taken``: single words, and
    words of digits with one space between them as one."""
    covered = set()
    for s, _, e in taken:
        first = bisect_right(tokens, (s, len(text) + 1)) - 1
        for i in range(max(first, 0), len(tokens)):
            if tokens[i][0] >= e:
                break
            covered.add(i)
    out, i = [], 0
    while i < len(tokens):
        s, e = tokens[i]
        word, last = text[s:e], i
        if i in covered or not _WORTH.search(word):
            i += 1
            continue
        if _NUMBER.fullmatch(word):
            while last + 1 < len(tokens) and last + 1 not in covered and tokens[last + 1][0] == tokens[last][1] + 1 and text[tokens[last][1]] == " " and _NUMBER.fullmatch(text[slice(*tokens[last + 1])].rstrip(".,;!?")):
                last += 1
                if not _NUMBER.fullmatch(text[slice(*tokens[last])]):
                    break
        out.append((*_edge(text, s, tokens[last][1]), i, last))
        i = last + 1
    return out


Seen = tuple[int, int, int, int, int, list[int]]


def identifiers(text: str) -> tuple[list[tuple[int, int, int]], list[Seen]]:
    """Base spans, and (start, end, kind or -1, kind by shape, hash of the value, contexts) of all seeds and candidates."""
    if not _WORTH.search(text):
        return [], []
    base = base_spans(text)
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    found = []
    for s, kind, e in base:
        first = bisect_right(tokens, (s, len(text) + 1)) - 1
        last = bisect_right(tokens, (e - 1, len(text) + 1)) - 1
        found.append((s, e, kind, 0, _hash(text[s:e]), first, last))
    for s, e, first, last in candidates(text, tokens, base):
        kinds = shapes(text[s:e]) if s < e else 0
        for kind in range(len(KINDS)):
            if kinds >> kind & 1:
                found.append((s, e, -1, kind, _hash(text[s:e]), first, last))
    if not found:
        return base, []
    h = np.concatenate([np.zeros(2, np.uint64), word_hashes(_raw(text)), np.zeros(1, np.uint64)])
    first, last = (np.array([x[i] for x in found]) for i in (5, 6))
    around = contexts(h[first], h[first + 1], h[last + 3]).T.view(np.int64)
    return base, [(s, e, kind, shape if kind < 0 else kind, value, c.tolist()) for (s, e, kind, shape, value, _, _), c in zip(found, around)]


SPANS = "array<struct<s:int,k:int,e:int>>"
SEEN = "array<struct<s:int,e:int,seed:boolean,k:int,value:long,ctx:array<long>>>"


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): row, a number of its own, doc_id, base ``spans``, and ``seen``."""

    def run(batches):
        spans_type = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
        seen_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("seed", pa.bool_()), ("k", pa.int32()), ("value", pa.int64()), ("ctx", pa.list_(pa.int64()))]))
        for batch in batches:
            spans, seen = [], []
            for text in batch.column(2):
                base, found = identifiers(text.as_py() or "")
                spans.append([{"s": s, "k": k, "e": e} for s, k, e in base])
                seen.append([{"s": s, "e": e, "seed": kind >= 0, "k": k, "value": v, "ctx": c} for s, e, kind, k, v, c in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, spans_type), pa.array(seen, seen_type)], names=["row", "doc_id", "spans", "seen"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"row long, doc_id long, spans {SPANS}, seen {SEEN}")


def _plain(raw: bytes) -> np.ndarray:
    """Of each word of ``raw``, whether it has no digit and no at sign."""
    b = np.frombuffer(raw, np.uint8)
    space = (b == 0x20) | (b >= 0x09) & (b <= 0x0D)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    marks = np.concatenate([[0], np.cumsum((b >= 0x30) & (b <= 0x39) | (b == 0x40))])
    return marks[edge[1::2]] == marks[edge[::2]]


def _first(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted ``columns`` differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def plain_fillers(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """(ctx, n_plain, out): how many different plain words fill each context of ``limits`` (ctx, most), over all texts.

    A context that has more than ``most`` of them within a portion of texts is ``out``, and its count is no whole one.
    """
    spark = docs.sparkSession
    by_slot = limits.groupBy(F.pmod("ctx", F.lit(SLOTS)).cast("int").alias("slot")).agg(F.max("most").alias("most")).toArrow()  # SLOTS rows at most
    most = np.full(SLOTS, -1, np.int32)
    most[by_slot.column("slot").to_numpy()] = np.minimum(by_slot.column("most").to_numpy(), np.iinfo(np.int32).max)
    shared = spark.sparkContext.broadcast(most)

    def run(batches):
        limit = shared.value

        def portion(ctx: list[np.ndarray], word: list[np.ndarray]):
            c, w = np.concatenate(ctx), np.concatenate(word)
            order = np.lexsort((w, c))
            c, w = c[order], w[order]
            new = _first(c, w)
            c, w = c[new], w[new]
            start = np.flatnonzero(_first(c))
            size = np.diff(np.append(start, len(c)))
            many = size > limit[c[start] % SLOTS]
            keep = ~np.repeat(many, size)
            out_c = np.concatenate([c[start[many]], c[keep]])
            out_w = pa.array(np.concatenate([np.zeros(int(many.sum()), np.int64), w[keep]]), mask=np.concatenate([np.ones(int(many.sum()), bool), np.zeros(int(keep.sum()), bool)]))
            return pa.RecordBatch.from_arrays([pa.array(out_c), out_w], names=["ctx", "word"])

        ctx, word, n = [], [], 0
        for batch in batches:
            for text in batch.column(0):
                raw = _raw(text.as_py() or "")
                h = word_hashes(raw)
                if not len(h):
                    continue
                padded = np.concatenate([np.zeros(2, np.uint64), h, np.zeros(1, np.uint64)])
                plain = _plain(raw)
                for c in contexts(padded[:-3], padded[1:-2], padded[3:]).view(np.int64):
                    hit = plain & (limit[c % SLOTS] >= 0)
                    ctx.append(c[hit])
                    word.append(h[hit].view(np.int64))
                n += len(h)
                if n >= PORTION:
                    yield portion(ctx, word)
                    ctx, word, n = [], [], 0
        if ctx:
            yield portion(ctx, word)

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "ctx long, word long").distinct()
    out = stage(found.join(limits.select("ctx"), "ctx", "left_semi").groupBy("ctx").agg(F.count("word").alias("n_plain"), F.max(F.col("word").isNull()).alias("out")), "pii-plain")
    shared.destroy()
    return out


def discoveries(docs: DataFrame, seen: DataFrame, least_support: int = LEAST_SUPPORT, trust: float = TRUST, rounds: int = ROUNDS) -> DataFrame:
    """(value, k, score) of the values that trusted patterns discover, seeds left out."""
    links = seen.select(F.explode("ctx").alias("ctx"), "k", "value", "seed").groupBy("ctx", "k", "value").agg(F.max("seed").alias("seed"))
    links = stage(links, "pii-links")
    supported = links.groupBy("ctx", "k").agg(F.count("*").alias("n")).where(F.col("n") >= least_support)
    known = seen.where("seed").select("value", "k", F.lit(1.0).alias("known")).distinct()
    graph = stage(links.join(supported.drop("n"), ["ctx", "k"], "left_semi").join(known, ["value", "k"], "left").select("ctx", "k", "value", F.coalesce("known", F.lit(0.0)).alias("known")), "pii-graph")
    # all that looks like an identifier counts among a context's fillers, whatever its kind
    held = links.join(graph.select("ctx").distinct(), "ctx", "left_semi").groupBy("ctx").agg(F.count_distinct("value").alias("n_identifiers"))
    most = F.floor(F.col("n_identifiers") * (1 - trust) / trust - 1 + 1e-9)
    # with more plain fillers than that no score of its instances makes a pattern trusted
    sizes = stage(held.withColumn("most", most).where("most >= 0"), "pii-sizes")
    discard(links)
    plain = plain_fillers(docs, sizes)
    counted = sizes.join(plain, "ctx", "left").where("not coalesce(out, false) and coalesce(n_plain, 0) <= most")
    edges = stage(graph.join(counted.select("ctx", (F.col("n_identifiers") + F.coalesce("n_plain", F.lit(0))).alias("fillers")), "ctx").withColumn("score", F.col("known")), "pii-edges")
    discard(graph, sizes, plain)
    for _ in range(rounds):
        # rounded, so that the order of a sum can't decide
        patterns = edges.groupBy("ctx", "k").agg(F.round(F.sum("score") / (F.max("fillers") + 1), 9).alias("confidence"))
        best = edges.join(patterns, ["ctx", "k"]).groupBy("value", "k").agg(F.max("confidence").alias("best"))
        scored = edges.drop("score").join(best, ["value", "k"])
        score = F.when(F.col("known") > 0, F.lit(1.0)).when(F.col("best") >= trust, F.col("best")).otherwise(F.lit(0.0))
        after = stage(scored.withColumn("score", score).drop("best"), "pii-edges")
        discard(edges)
        edges = after
    return edges.where("score > 0 and known = 0").select("value", "k", "score").distinct()


def find(docs: DataFrame, least_support: int = LEAST_SUPPORT, trust: float = TRUST, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and ``spans``, array of (s, k, e) by start and kind. Kinds 0 to 3 are
    base spans in the order of ``KINDS``; 4 to 7 are those that contexts discovered. Ends are exclusive, in code points.

    A candidate whose value is a seed's elsewhere is discovered as well. Null and empty texts have no
    spans; long ones take linear time; a null doc_id stays null; repeated rows are each scanned; extra columns are
    ignored; an empty table gives no rows.
    """
    scanned = stage(scan(docs), "pii")
    seen = scanned.select("row", F.explode("seen").alias("x")).select("row", "x.*")
    found = discoveries(docs, seen, least_support, trust, rounds)
    known = seen.where("seed").select("value", "k", F.lit(1.0).alias("score")).distinct()
    hits = seen.where("not seed").join(found.unionByName(known), ["value", "k"])
    one = hits.groupBy("row", "s", "e").agg(F.max(F.struct("score", (-F.col("k")).alias("less"))).alias("top"))
    added = one.groupBy("row").agg(F.collect_list(F.struct("s", (len(KINDS) - F.col("top.less")).cast("int").alias("k"), "e")).alias("added"))
    none = F.array().cast(SPANS)
    return scanned.join(added, "row", "left").select("doc_id", F.array_sort(F.concat("spans", F.coalesce("added", none))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, and spans as strings; discovered ones are of kind context_..."""
    names = F.array(*[F.lit(k) for k in (*KINDS, *(f"context_{k}" for k in KINDS))])

    def text(x: Column) -> Column:
        return F.concat_ws(":", F.get(names, x.k), x.s.cast("string"), x.e.cast("string"))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x.k == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x.k < len(KINDS))
    return found.select("doc_id", *map(number, KINDS), F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"))
